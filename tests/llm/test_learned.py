"""Learned operators: held-out accuracy, exact bounds, and the URL vocabulary."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import language, quality, queries, rules, urls

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    rows = queries.op3_quality_classifier(spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for label, s in judged if label == value] for value in (1, 0))
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def test_attention_gradients():
    """The gradients are what finite differences say, and training follows them."""
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(9, quality.FEATURES))
    starts, labels = np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    before = quality.fit(x, starts, labels, steps=0)
    loss = lambda m: -np.mean(
        [np.log(s if y else 1 - s) for s, y in zip(m.forward(x, starts)["score"], labels)]
    )
    weights = np.array([0.2, 0.5, 0.3])

    def weighted_loss():
        scores = before.forward(x, starts)["score"]
        return -(weights * (labels * np.log(scores) + (1 - labels) * np.log(1 - scores))).sum()

    found = quality.gradients(before, x, starts, labels, weights)
    for name, values in before.parts.items():
        flat, slopes = values.reshape(-1), np.asarray(found[name]).reshape(-1)
        for k in random_.integers(0, flat.size, 12):
            kept, step = flat[k], 1e-6
            flat[k] = kept + step
            above = weighted_loss()
            flat[k] = kept - step
            below = weighted_loss()
            flat[k] = kept
            assert abs((above - below) / (2 * step) - slopes[k]) < 1e-6, (name, k)
    after = quality.fit(x, starts, labels, steps=60)
    assert loss(after) < 0.2 * loss(before)
    weight = after.forward(x, starts)["weight"]
    assert np.allclose(np.add.reduceat(weight, starts), 1)


def test_quality_edges(frame):
    text = "plain words that go on for a while and then stop again. " * 30
    documents = frame(
        "doc_id long, text string, quality string",
        *((k, text + str(k) if k % 2 else "#$% @@ !! " * 40 + str(k), "clash") for k in range(40)),
        (None, None, None), (50, "", "clash"), (50, "", "clash"),
    )
    labels = frame("doc_id long, quality int, x int", *((k, k % 2, 0) for k in range(40)), (None, 1, 0), (3, None, 0), (3, 1, 0))
    model = quality.learn(documents, labels)
    rows = quality.score_quality(documents, model).collect()
    assert len(rows) == 43
    assert all(r.quality.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 40)
    empty = {r.quality.score for r in rows if r.doc_id in (None, 50)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    assert quality.learn(documents, labels.limit(0)) is None
    assert quality.score_quality(documents, None).where("quality.predicted = 1").count() == 43
    assert quality.score_quality(documents.limit(0), model).count() == 0


def test_every_passage_of_a_text_is_read():
    text = bytes(range(256)) * 40
    pieces = quality.passages(text)
    assert b"".join(pieces) == text and max(map(len, pieces)) <= quality.PASSAGE_BYTES
    assert quality.passages(b"") == [b""]


def test_language_on_held_out_documents(spark):
    rows = queries.op10_language(spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_words_are_apart():
    for count in (1, 2, 3, 4, 5, 12, 40):
        codes = language.code_matrix(count)
        assert codes.shape[0] == count and set(np.unique(codes)) <= {-1, 1}
        gaps = [(codes[a] != codes[b]).sum() for a in range(count) for b in range(a)]
        assert not gaps or min(gaps) >= {2: 1, 3: 2, 4: 4, 5: 8}.get(count, count)


def test_language_edges(frame):
    random_ = random.Random(3)
    languages = {"aa": "kalo mine tura", "bb": "zzyx qwer vbnm", "cc": "ñandú éste ça"}
    rows = [(k, " ".join(random_.choice(words.split()) for _ in range(12)), lang, "clash")
            for k, (lang, words) in enumerate(list(languages.items()) * 30)]
    extra = [(None, None, "aa", None), (900, "", None, ""), (901, "12 -- 7", "bb", ""), (902, "kalo", None, ""), (902, "kalo", None, "")]
    documents = frame("doc_id long, text string, lang string, language string", *rows, *extra)
    model = language.learn(documents)
    got = language.identify(documents, model).collect()
    assert all(r.language.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 90)
    assert [r.language.lang_pred for r in got if r.doc_id in (None, 900, 901)] == ["und"] * 3
    assert [r.language.lang_pred for r in got if r.doc_id == 902] == ["aa"] * 2
    assert language.learn(documents.where("lang is null")) is None
    assert language.identify(documents, None).where("language.lang_pred = 'und'").count() == len(rows) + 5
    one = language.learn(documents.where("lang = 'aa'"))
    assert language.identify(documents, one).where("language.lang_pred = 'bb'").count() == 0


def counts_by_hand(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))


def rule_texts():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a b c d e a b c d e", "x " * 50, "é\u00a0ü \u2003 z" * 20, "l1\nl1\n\nl1 \n l1\nl1\r\nl1\r"]
    for _ in range(80):
        words = [rng.choice(["a", "b", "#c", "Dé", "%%", "wordword"]) for _ in range(rng.randrange(4, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words))
    return texts


def test_counts_by_hand(frame):
    texts = rule_texts()
    documents = frame("doc_id long, text string, lang string, n_words int", *((k, t, None, 1) for k, t in enumerate(texts)))
    labels = frame("doc_id long, quality int")
    for row in rules.judge(documents, labels).collect():
        n_words, chars, symbols, dup, repeated = counts_by_hand(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            n_words, chars, symbols, dup, repeated
        ), texts[row.doc_id]
        assert row.base_failed == (n_words < 10 or 100 * repeated > 20 * n_words)
        assert row.kept == (not row.base_failed)
    assert rules.judge(documents.limit(0), labels).count() == 0


def bound_by_hand(rejected, total, error):
    """Upper limit of the rate, by bisection on the exact binomial distribution."""
    low, high = 0.0, 1.0
    for _ in range(60):
        rate = (low + high) / 2
        chance = sum(math.comb(total, k) * rate**k * (1 - rate) ** (total - k) for k in range(rejected + 1))
        low, high = (rate, high) if chance > error else (low, rate)
    return high


@pytest.mark.parametrize("total", [1, 40, 400])
def test_exact_bounds(total):
    for rejected in {0, 1, total // 20, total // 3}:
        for limit in (0.01, 0.05, 0.3):
            for error in (0.05, 0.001):
                bound = bound_by_hand(rejected, total, error)
                if abs(bound - limit) > 1e-9:
                    assert rules.within_bound(rejected, total, limit, error) == (bound <= limit)


def test_cutoffs_hold_in_each_stratum(frame):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for k in range(5200):
        mark = 1.0 if k >= 5000 else {0: 0.0, 1: 0.12}[k % 2]
        text = " ".join(word() + ("###" if rng.random() < mark else "") for _ in range(40))
        rows.append((k, text, ["xx", "yy"][k % 2]))
    documents = frame("doc_id long, text string, lang string", *rows, (9000, " ".join(word() for _ in range(20)) + " #" * 9, None))
    labels = frame("doc_id long, quality int", *((k, int(k < 5000)) for k in range(5200)), (None, 1), (1, None))
    judged = rules.judge(documents, labels).collect()
    for stratum in (0, 1):
        good = [r for r in judged if r.doc_id < 5000 and r.doc_id % 2 == stratum and not r.base_failed]
        assert sum(not r.kept for r in good) <= 0.02 * len(good)
    bad = [r for r in judged if 5000 <= r.doc_id < 5200 and not r.base_failed]
    assert bad and not any(r.kept for r in bad)
    assert [r.kept for r in judged if r.doc_id == 9000] == [not r.base_failed for r in judged if r.doc_id == 9000]


def test_small_strata_share_a_bound(frame):
    """Six strata of 60 good documents: none passes alone, all together do."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = [(k, " ".join(word() for _ in range(40)), f"s{k % 6}") for k in range(360)]
    rows += [(1000 + k, " ".join(word() + "###" for _ in range(40)), f"s{k % 7}") for k in range(21)]
    documents = frame("doc_id long, text string, lang string", *rows)
    labels = frame("doc_id long, quality int", *((k, int(k < 1000)) for k, _, _ in rows))
    judged = {r.doc_id: r for r in rules.judge(documents, labels).collect()}
    assert sum(not judged[k].kept for k in range(360)) <= 0.02 * 360
    # The seventh stratum has no good document, so nothing is known about it.
    assert all(judged[1000 + k].kept == (k % 7 == 6 and not judged[1000 + k].base_failed) for k in range(21))
    few = labels.where("doc_id < 100")
    assert all(r.kept != r.base_failed and not r.broken for r in rules.judge(documents, few).collect())


def test_first_step(frame):
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"
    rng = random.Random(22)
    rows = [(n, n * rng.randrange(1, 50), *(rng.randrange(0, n) for _ in range(5))) for n in (rng.randrange(5, 200) for _ in range(60))]
    measured = rules.measures()
    values = frame(schema, *rows).select(rules.first_step().alias("first"), *(m.alias(name) for name, (m, _) in measured.items()))
    for row in values.collect():
        steps = [
            step
            for step in range(rules._steps())
            if any(row[name] > rules._cutoff(cutoffs, step) for name, (_, cutoffs) in measured.items())
        ]
        assert row["first"] == min(steps, default=rules._steps())
        assert steps == list(range(row["first"], rules._steps()))


def test_urls(frame):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "https://WWW.Example.com/en/1?casino": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://notexample.com": ("notexample.com", "", None, "allow"),
        "http://a.net/fr/x#/y": ("a.net", "/fr/x", "net/fr/", "block"),
        "x://casinos.org/": ("casinos.org", "/", None, "allow"),
        "x://a.org/Casino": ("a.org", "/Casino", None, "block"),
        "x://free.org/free/free": ("free.org", "/free/free", None, "allow"),
        "x://free-bets.org?q=://b/c": ("free-bets.org", "", None, "block"),
        "x://é.org/bet\nwin": ("é.org", "/bet\nwin", None, "block"),
    }
    pages = frame("page_id long, url string, host string", *((k, url, "clash") for k, url in enumerate(cases)))
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert [rows[k] for k in range(len(cases))] == list(cases.values())
    assert urls.judge_urls(pages.limit(0)).count() == 0
    long = frame("page_id long, url string", (1, "x://a.org/" + "ab" * 300_000 + "/xxx"), (1, None))
    assert {r.verdict for r in urls.judge_urls(long).collect()} == {"block", "allow"}


@pytest.mark.parametrize("block_bytes", [urls.VOCABULARY_BYTES, 3000])
def test_a_vocabulary_of_thousands(frame, block_bytes):
    """Terms overlap and nest and have weights of their own; each is looked for by itself here."""
    rng = random.Random(17)
    letters = "abcABC0-./é"
    terms = {"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(4000)}
    table = [(term, rng.random() < 0.02, rng.choice((0.1, 0.2, 0.5, 1.0))) for term in sorted(terms)]
    table += [table[0], ("", True, 1.0), (None, True, 1.0), ("zz", None, None), ("ZZ", False, 0.5), ("yy", False, 9.0)]
    pages = [(k, "x://" + "".join(rng.choices(letters, k=rng.randrange(0, 40)))) for k in range(150)]
    pages += [(500, "a zz b"), (501, None), (502, "yy"), (503, "yy zz"), (504, "")]
    fold = {code: code + 32 for code in range(65, 91)}
    known = {}
    for term, strict, weight in table:
        if term:
            key, own = term.translate(fold), (bool(strict), 1.0 if weight is None else weight)
            known[key] = tuple(map(max, known.get(key, own), own))
    inner = set("abcdefghijklmnopqrstuvwxyz0123456789")
    want = {}
    for page, url in pages:
        text = (url or "").translate(fold)
        found = set()
        for term in known:
            at = text.find(term)
            while at >= 0:
                if not (at and text[at - 1] in inner) and text[at + len(term) : at + len(term) + 1] not in inner:
                    found.add(term)
                at = text.find(term, at + 1)
        strict = sorted(t for t in found if known[t][0])
        soft = sorted(t for t in found if not known[t][0])
        bad = bool(strict) or (len(soft) > 1 and sum(known[t][1] for t in soft) >= 1.5)
        want[page] = (strict, soft, "block" if bad else "allow")
    vocabulary = frame("term string, strict boolean, weight double", *table)
    judged = urls.judge_urls(frame("page_id long, url string", *pages), (), vocabulary, 1.5, block_bytes)
    rows = {r.page_id: (list(r.strict_terms), list(r.soft_terms), r.verdict) for r in judged.collect()}
    assert rows == want and len({verdict for _, _, verdict in want.values()}) == 2
    empty = urls.judge_urls(frame("page_id long, url string", *pages), (), vocabulary.where("false"))
    assert {r.verdict for r in empty.collect()} == {"allow"}


def test_measures_reject_only_above(frame):
    row = frame("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long", (0,) * 7)
    assert all(row.select(measure.alias("m")).first().m == 0.0 for measure, _ in rules.measures().values())
    assert all(cutoffs == sorted(cutoffs, reverse=True) for _, cutoffs in rules.measures().values())
    assert row.select(F.lit(1)).count() == 1
