"""Spelling variants, secret scans and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import importance, secrets, variants
from tessera.llm.common import table
from tessera.llm.queries import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows(spark, path, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{name}.parquet").select(*(("doc_id",) if name == "documents" else ("item_id",)), "text").collect()]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


WORD = st.text("abé", min_size=0, max_size=7)


@settings(max_examples=200, deadline=None)
@given(sets=st.lists(st.sets(WORD, min_size=1, max_size=12), min_size=1, max_size=3))
def test_active_nodes_find_all_pairs(sets):
    names = [(g, w) for g, s in enumerate(sets) for w in sorted(s)]
    data = np.array([ord(c) for _, w in names for c in w], np.uint32)
    a, b = variants.near(data, np.cumsum([0, *(len(w) for _, w in names)]), np.array([g for g, _ in names]))
    got = list(zip(a.tolist(), b.tolist()))
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x, (g, v) in enumerate(names) for y, (h, w) in enumerate(names) if g == h and one_edit(v, w)}


def forms(counts):
    words = sorted(counts)
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-counts[v], v)) if near[w] else None for w in words}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("most", [1 << 20, 40, 1])
def test_tries_of_any_size(spark, most):
    """However small a trie may be, and so however often tries are parted, no pair is lost or found twice."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 14))) for _ in range(60)] + ["international" * k for k in (1, 2, 9)]
    words = set(base)
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]]))
    counts = {w: rng.choice([5, 6, 40, 400, 9000]) for w in sorted(words)}
    made = table(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.grouped(made, most=most).collect()}
    assert got == forms(counts)


def counted(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_op11_whole_table(spark, small):
    want = forms(counted(rows(spark, small)))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op11_spelling_variants"](spark, small).collect()}
    assert got == want and any(x[2] for x in want.values())


def test_vocabulary_of_odd_rows(spark):
    docs = [(1, "Straße ÄÄÄÄÄÄ×÷ " * 5), (1, "Straße"), (None, "Straße abcdef " * 3), (2, None), (3, ""), (4, "x" * 200_000 + " ")] + [(4, "x" * 200_000)] * 4
    got = {r.word: r.n for r in variants.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == counted(docs) and len(got) == 3


#: The base rules once more, as they are stated.
STATED = [("assign", r"""((?i:(?a:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]


def base(text):
    """Base spans by the stated patterns over code points; letters beyond ASCII that fold to ASCII ones don't count."""
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(STATED) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n]
    return [f"{STATED[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "passwd", ":", "=", " ", '"', "'", "AKIA", "AKIAQ", "Z9" * 8, "deadbeef", "0123456789",
    "é", "漢", "ſecret", "toKen", ".", "short", "=="]), max_size=14))
def test_base_spans_are_as_stated(parts):
    text = "".join(parts)
    point = lambda k: len(text.encode()[:k].decode())
    assert [f"{STATED[k][0]}:{point(a)}:{point(b)}" for a, k, b in secrets.base_spans(text.encode())] == base(text)


def test_op12_base_of_whole_table(spark, small):
    got = {r.doc_id: r for r in QUERIES["op12_secret_scans"](spark, small).collect()}
    docs = rows(spark, small)
    assert len(got) == len(docs) and sum(r.n_spans for r in got.values())
    for key, text in docs:
        want = base(text)
        r = got[key]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k, *_ in STATED)


def sample(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def test_random_strings_are_secrets_and_text_is_not(spark):
    """Of random strings of 32 and more symbols nine tenths are found, whatever their encoding; ordinary words, names and paths hardly ever."""
    rng = random.Random(12)
    syllables = ["ver", "ein", "tion", "con", "der", "men", "to", "re", "list", "get", "user", "path", "ing", "able", "data", "un", "schaft", "al", "ser", "vice"]
    docs, made = [], {}
    kinds = {"base16": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/"}
    for key in range(600):
        name = list(kinds)[key % len(kinds)]
        text = sample(rng, kinds[name], rng.choice([32, 40, 64, 90]))
        made[key] = text
        docs.append((key, "der größte Teil of the plain text is here " + text + " und so weiter, and so on. " + " ".join(sample(rng, LOWER[:9] + "eeeaatt", 5) for _ in range(40))))
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(5, 9)))
    for key in range(600, 2400):
        word = [plain, lambda: plain().title() + plain().title(), lambda: "/".join(plain() for _ in range(3)), lambda: plain() + str(rng.randint(1990, 2030)),
            lambda: plain().upper(), lambda: sample(rng, DIGITS, 20), lambda: "abcdef" * 6 + "A1", lambda: "_".join(plain() for _ in range(3)),
            lambda: plain() + "-2024-03-" + sample(rng, DIGITS, 6)][key % 9]()
        docs.append((key, "a word that is long: " + word + " and the end of it, nothing more"))
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    hit = Counter()
    for key, value in made.items():
        at = text[key].index(value)
        hit[list(kinds)[key % 5]] += any(int(s.split(":")[1]) <= at and int(s.split(":")[2]) >= at + len(value) for s in got[key].spans.split(",") if s)
    assert all(hit[k] >= 0.9 * 120 for k in kinds), hit
    wrong = [got[k].spans for k in range(600, 2400) if any(not s.startswith("hex:") for s in got[k].spans.split(",") if s)]
    assert len(wrong) <= 0.01 * 1800, wrong[:5]


def test_battery_is_even_on_random_symbols():
    """Chances of the battery are about uniform where the symbols are random, with a somewhat heavier tail at 20 symbols; a counting alphabet and repeats fail."""
    rng = np.random.default_rng(5)
    for size, n in ((16, 40), (32, 32), (64, 20), (62, 200)):
        p = np.array([secrets.combined(secrets.battery(rng.integers(0, size, n), size)) for _ in range(3000)])
        assert abs((p < 0.5).mean() - 0.5) < 0.06 and (p < 0.01).mean() < 0.03 and (p < secrets.NOT_RANDOM).mean() < 0.01
    assert secrets.combined(secrets.battery(np.arange(64), 64)) < secrets.NOT_RANDOM
    assert secrets.combined(secrets.battery(np.zeros(30, int), 16)) < secrets.NOT_RANDOM


def test_evidence_is_one_on_average_over_text():
    """The ratio of even to textual shares has mean 1 where symbols come as often as in text: an e-value, at every length."""
    rng = np.random.default_rng(6)
    counts = np.zeros(256)
    for k, c in enumerate("etaoinshrdlu0123ABC"):
        counts[ord(c)] = 100 - 5 * k
    for e, logs in enumerate(secrets.ratios(counts)):
        size = len(secrets.ENCODINGS[e][1])
        assert abs(sum(np.exp(-np.array(logs)) / size) - 1) < 1e-9 and max(logs) <= math.log(10) + 1e-9
    text = np.exp(-np.array(logs)) / size
    assert abs(np.exp(np.array(logs)[rng.choice(size, (200_000, 3), p=text)].sum(1)).mean() - 1) < 0.05
    assert secrets.ratios(np.zeros(256))[0] == [0.0] * 16


def resample(docs, target, n_gram, buckets, seed, percent, least):
    def feats(text):
        w = WORDS.findall(low(text))
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, n_gram + 1) for k in range(len(w) - n + 1)]

    source, aim = Counter(b for _, t in docs for b in feats(t)[1]), Counter(b for t in target for b in feats(t)[1])
    s_all, t_all = sum(source.values()) + buckets, sum(aim.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * s_all / ((source[b] + 1) * t_all)))
    out, able = {}, []
    for key, text in docs:
        w, f = feats(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[key] = [len(f), weight, score, None]
        if len(w) >= least:
            able.append((-score, key))
    for rank, (_, key) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[key][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def test_op13_whole_table(spark, small):
    want = resample(rows(spark, small), [t for _, t in rows(spark, small, "benchmark")], 1, 10_000, 2024, 10, 20)
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op13_importance_resampling"](spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("n_gram", [1, 2, 3])
def test_resampling_of_odd_rows(spark, n_gram, monkeypatch):
    """Longer n-grams, ties, null and empty texts, texts that touch, and dictionaries that start anew."""
    monkeypatch.setattr(importance, "KEPT", 5)
    rng = random.Random(13)
    vocab = ["a", "b", "ä", "ab", "Zz", "7", "漢字", "b-b", "A"]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))) for k in range(300)] + [(900, None), (901, ""), (902, "...")]
    target = ["ab ab 7 ä", None, "", "zz 漢字 b"]
    made = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, score string, n_words int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance.resampled(made, aim, n_gram, 50, 7, 35, 4).collect()}
    assert got == resample(docs, target, n_gram, 50, 7, 35, 4)


def test_all_may_be_drawn_or_none(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(40)], "doc_id long, text string")
    aim = spark.createDataFrame([], "text string")
    assert importance.resampled(docs, aim, percent=100, least=1).where("rank IS NULL").count() == 0
    assert importance.resampled(docs, aim, percent=0, least=1).where("rank IS NOT NULL").count() == 0
    assert importance.resampled(docs, aim, least=4).where("rank IS NOT NULL").count() == 0
    assert importance.resampled(docs.where("false"), aim).count() == 0
