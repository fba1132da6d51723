"""Streaming use.

There are no stateful streaming operators: line parsing and redaction
(``operators.events.parse_lines``, ``operators.events.redact_events``) are narrow, stateless
column expressions, so they apply unchanged to a ``readStream`` DataFrame with the columns
``incident_id``, ``line_number`` and ``raw_line``.
"""
