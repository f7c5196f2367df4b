"""The operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate, encode, graph, jaccard, license_texts, licenses, linededup, media, packing, pii, quality, tokencount, tokenfile
from tessera.llm.queries import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows(spark, path):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


LETTERS = st.text(st.sampled_from(list("ab éÉß.,!'-s' \n\t|1½İΣ<>漢𝒜́ ")), max_size=60)


@pytest.mark.parametrize("path", [encode.WORD, encode.BYTE])
@settings(max_examples=150, deadline=None)
@given(values=st.lists(LETTERS, max_size=8))
def test_encoder_is_the_library(path, values):
    enc = _small(path)
    ids, at = enc.encode(values)
    for k, v in enumerate(values):
        assert ids[at[k] : at[k + 1]].tolist() == enc.direct(v)


_KEPT = {}


def _small(path):
    return _KEPT.setdefault(path, encode.Encoder(path, slots=64))


def test_encoder_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(encode, "LONGEST", 100)
    text = "some words and more of them " * 50
    enc = encode.Encoder(encode.BYTE, slots=64)
    assert enc.encode([text, "a"])[0].tolist() == enc.direct(text) + enc.direct("a")


@settings(max_examples=150, deadline=None)
@given(text=LETTERS, edits=st.lists(st.tuples(st.integers(-2, 70), st.integers(0, 20), LETTERS), max_size=4))
def test_edits_count_like_the_edited_text(text, edits):
    enc = _small(encode.WORD)
    tree = tokencount.Tree(enc, text)
    for a, n, new in edits:
        tree.edit(a, a + n, new)
        x = min(max(0, a), len(text))
        text = text[:x] + new + text[min(max(x, a + n), len(text)) :]
        assert (tree.text, tree.count) == (text, len(enc.direct(text)))


def within_bounds(tree):
    for k, leaf in enumerate(tree.leaves):
        borders = [0, *(m.start() for m in tokencount.BORDER.finditer(leaf) if m.start()), len(leaf)]
        assert len(leaf) >= tokencount.LEAST or k == len(tree.leaves) - 1, (k, len(leaf))  # what is left over at a text's end
        assert len(leaf) <= tokencount.MOST + max(b - a for a, b in zip(borders, borders[1:])), (k, len(leaf))


@pytest.mark.parametrize("kind", ["words", "han"])
def test_trees_do_not_decay(kind):
    """After a large insertion and a thousand edits leaves are within bounds, counts are right, and an edit encodes no more than in a fresh tree."""
    enc, rng = encode.Encoder(encode.WORD), random.Random(4)
    words = (lambda n: " ".join(rng.choice(["alpha", "be", "gamma,", "delta.", "x1"])
        for _ in range(n))) if kind == "words" else (lambda n: "".join("".join(rng.choice("天地玄黃宇宙洪荒日月") for _ in range(rng.randint(2, 9))) + rng.choice("。，、")
        for _ in range(n)))
    text = words(50)
    tree = tokencount.Tree(enc, text)
    big = words(20_000)
    tree.edit(7, 9, big)
    text = text[:7] + big + text[9:]
    assert len(tree.leaves) > 60 and tree.count == len(enc.direct(text))
    within_bounds(tree)
    tree.work = 0
    for _ in range(1000):
        a = rng.randrange(len(text) + 1)
        b, new = min(len(text), a + rng.choice([0, 1, 5, 40])), words(rng.choice([0, 1, 3, 9]))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
    assert tree.text == text and tree.count == len(enc.direct(text)) and tree.work / 1000 < 1500
    within_bounds(tree)
    tree.edit(0, len(text) - 3, "")
    assert tree.text == text[-3:] and len(tree.leaves) <= 2 and tree.count == len(enc.direct(text[-3:]))


def test_edits_touch_little(spark):
    enc = encode.Encoder(encode.WORD)
    text = "plain words in a row, again and again. " * 2000
    tree = tokencount.Tree(enc, text)
    tree.edit(40_000, 40_010, "new")
    assert tree.work < 200 and tree.count == len(enc.direct(text[:40_000] + "new" + text[40_010:]))


@pytest.mark.parametrize("bits", [8, 1])
@settings(max_examples=40, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=300), block=st.sampled_from([1, 7, 64, 1 << 16]))
def test_token_file_round_trip(bits, ids, block):
    sizes = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
    keys, n, back = tokenfile.unpack(tokenfile.pack([None, -5], sizes, np.array(ids, np.uint32), bits, block))
    assert keys == [None, -5] and n.tolist() == sizes.tolist() and back.tolist() == ids


def test_op5_in_order(spark, small):
    tok = Tokenizer.from_file(encode.WORD)
    got, start = {r.doc_id: r for r in QUERIES["op5_token_id_output"](spark, small).collect()}, 0
    for key, text in sorted(rows(spark, small)):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def applied(text, edits):
    for a, b, new in edits:
        a = min(max(0, a), len(text))
        text = text[:a] + new + text[max(a, min(b, len(text))) :]
    return text


def test_op7_counts(spark, small):
    """Counts before and after the query's edits, by encoding whole texts."""
    tok = Tokenizer.from_file(encode.WORD)
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') text",
        *(f"pmod(xxhash64(doc_id, {k}), greatest(length(coalesce(text, '')), 1)) p{k}" for k in (1, 2, 3)))
    want = {}
    for r in docs.collect():
        after = applied(r.text, [(r.p1, r.p1 + 12, ""), (r.p2, r.p2, " inserted words, 42"), (r.p3, r.p3 + 5, r.text[:9])])
        want[r.doc_id] = tuple(len(tok.encode(t, add_special_tokens=False).ids) for t in (r.text, after))
    out = QUERIES["op7_token_counts"](spark, small).collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in out} == want
    assert sum(r.n_encoded_again for r in out) < sum(r.n_chars for r in out)


def test_trees_are_kept_between_edits(spark):
    tok = Tokenizer.from_file(encode.WORD)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é.,\n\t\xa0'!1") for _ in range(n)) for n in (0, 1, 40, 3000, 9000)] + [None]
    now = {k: t or "" for k, t in enumerate(texts)}
    trees = tokencount.trees(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for _ in range(3):
        edits = {k: [(a := rng.randrange(len(t) + 5), a + rng.randrange(30), rng.choice(["", " x", "\ty\n", "longer words, 12 of them "])) for _ in range(rng.randrange(4))] for k, t in now.items()}
        kept = common.table(trees, "trees")
        rows_ = spark.createDataFrame([(k, e) for k, e in edits.items()], f"doc_id long, edits {tokencount.EDITS}")
        trees = common.table(tokencount.edited(kept.join(rows_, "doc_id")), "edited")
        now = {k: applied(t, edits[k]) for k, t in now.items()}
        assert {r.doc_id: ("".join(r.leaves), r.n_tokens_after, r.chars[1]) for r in trees.collect()} == {k: (t, len(tok.encode(t, add_special_tokens=False).ids), len(t)) for k, t in now.items()}


def test_op10_packs_all(spark, small):
    tok = Tokenizer.from_file(encode.BYTE)
    out, total = defaultdict(list), 0
    for r in QUERIES["op10_best_fit_packing"](spark, small).collect():
        out[r.doc_id].append(r)
    for key, text in rows(spark, small):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(out[key], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
        total += at
    bins = defaultdict(list)
    for r in (x for p in out.values() for x in p):
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b[:-1])]).tolist() and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-total // 1024) * 1.01 + 1


def test_evolution_keeps_items():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    one = packing.evolve(sizes, 100, 1, [], 3, 4)
    two = packing.evolve(sizes, 100, 2, [one], 3, 4)
    for bins, free in (one, two):
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(100 - sum(sizes[i] for i in b) == f >= 0 for b, f in zip(bins, free, strict=True))
    assert packing.fitness(two) <= packing.fitness(one)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 60_000])
def test_decontamination_by_brute_force(spark, small, block):
    found = decontaminate.report(decontaminate.contamination(common.documents(spark, small), common.documents(spark, small, "benchmark"), block=block))
    windows = defaultdict(set)
    for r in common.documents(spark, small, "benchmark").collect():
        w = WORDS.findall(low(r.text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    texts = dict(rows(spark, small))
    hits = 0
    for r in found.collect():
        w, hit, items = WORDS.findall(low(texts[r.doc_id])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= x
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        hits += bool(hit)
    assert hits


def test_items_without_id(spark):
    a, b = "one two three four five six seven eight nine ten", "un deux trois quatre cinq six sept huit neuf dix"
    items = spark.createDataFrame([(None, a), (None, b), ("i", b)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {a} there"), (2, f"so {b} there"), (3, f"{a} {b}"), (4, "none here")], "doc_id long, text string")
    out = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.report(decontaminate.contamination(docs, items)).collect()}
    assert out == {1: (10, 0, None, True), 2: (10, 1, ["i"], True), 3: (20, 1, ["i"], True), 4: (0, 0, None, False)}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "One two, three"), (2, "two"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "TWO"), ("b", "one two three four"), ("c", "two three")], "item_id string, text string")
    out = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.report(decontaminate.contamination(docs, items)).collect()}
    assert out == {1: (2, ["a", "c"]), 2: (1, ["a"]), 3: (0, None)}


def test_media_round_trip_and_boxes(spark, small):
    texts = dict(rows(spark, small))
    for r in QUERIES["op3_media_columns"](spark, small).collect():
        raw = texts[r.doc_id].encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    big = bytes(range(256)) * 1000
    (t,) = media.probe(media.mux(big))
    file = media.mux(big)
    assert b"".join(file[a:b] for a, b in t["ranges"]) == big and (t["codec"], t["duration"], t["chunks"]) == ("ipcm", len(big), 4)
    assert media.probe(b"no boxes here") == [] and media.probe(b"") == [] and media.probe(file[: len(file) - 100]) == []


def test_media_sync_samples():
    """A track with samples of several sizes in two chunks, of which two are sync samples."""
    import struct

    full, box = media._full, media._box
    payload = b"aaabbbbbccd"
    at = 8
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", struct.pack(">III", 1, 4, 10)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)), full(b"stsz", struct.pack(">II4I", 0, 4, 3, 5, 2, 1)),
        full(b"stco", struct.pack(">III", 2, at, at + 10)), full(b"stss", struct.pack(">III", 2, 2, 4)))
    file = box(b"mdat", payload) + box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 40, 0, 0)), box(b"minf", stbl))))
    (t,) = media.probe(file)
    assert (t["codec"], t["timescale"], t["duration"], t["keyframes"]) == ("avc1", 600, 40, 2)
    assert [file[a:b] for a, b in t["ranges"]] == [b"bbbbb", b"d"]


def similar_by_brute_force(docs):
    sets = {}
    for key, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[key] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (len(s), root(k)) for k, s in sets.items()}


def made_texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    out = []
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # like the base, but hardly like each other
        x = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            x[rng.randrange(120)] = rng.choice(vocabulary)
        out.append(" ".join(x))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out += [" ".join([rng.choice(vocabulary) for _ in range(40)] + passage) for _ in range(40)]
    for _ in range(80):
        x = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        out += [" ".join(x), " ".join([*x[:-1], "z"])]
    out += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10))) for _ in range(120)]
    return [*out, None, "", " ", "A b", "a  B"]


def test_similar_by_brute_force(spark):
    docs = list(enumerate(made_texts()))
    expected = similar_by_brute_force(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == expected
    assert max(Counter(c for _, c in expected.values()).values()) > 50  # the family is one component, though the base itself is not there


def test_all_links_are_counted(spark):
    docs = list(enumerate(made_texts()))
    sets = {}
    for key, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[key] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    kinds = set(sets.values())
    want = {k: sum(x != s and 100 * len(s & x) >= 75 * len(s | x) for x in kinds) if s else 0 for k, s in sets.items()}
    out = jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), links=True).collect()
    assert {r.doc_id: r.n_links for r in out} == want and max(want.values()) > 20


def test_similar_in_blocks_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    docs = list(enumerate(made_texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == similar_by_brute_force(docs)


def test_similar_leaves_only_the_tables_of_its_result(spark, tmp_path, monkeypatch):
    number = itertools.count()
    monkeypatch.setattr(common, "scratch", lambda _, name: f"{tmp_path}/tessera-{next(number)}/{name}")
    out = jaccard.similar(spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string").repartition(3))
    left = sorted(p.name for p in tmp_path.glob("tessera-*/*"))
    assert left == ["info", "named"] and out.count() == len(made_texts())


def test_scratch_without_a_named_folder():
    """A session that names no folder makes its own on one machine, the same one for all tables; one on a cluster is an error."""
    made = []
    sc = SimpleNamespace(master="local[2]", getConf=lambda: {}, getCheckpointDir=lambda: made[0] if made else None, setCheckpointDir=made.append)
    session = SimpleNamespace(conf={}, sparkContext=sc)
    a, b = common.scratch(session, "x"), common.scratch(session, "y")
    assert len(made) == 1 and a.startswith(made[0]) and b.startswith(made[0]) and a != b
    made.clear()
    sc.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        common.scratch(session, "x")


def test_similar_sets_share_needed_signatures():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(4, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, len(a) // 7 + 1))
        b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        sig, owner, own, spare = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        shared = np.intersect1d(sig[(owner == 0) & own], sig[(owner == 1) & own])
        assert len(shared) >= max(1, spare[0].max() if spare[0].min() > 0 else 1)


def test_components(spark):
    links = [(k + 1, k) for k in range(30)] + [(100, 101), (103, 101), (200, 201)]
    out = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert out == {**{k: 0 for k in range(1, 31)}, 101: 100, 103: 100, 201: 200}


def test_line_dedup(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    run = lambda n: " ".join(word() for _ in range(n))
    passage, line = run(60), run(12)
    texts = [run(80) + " " + passage + " " + run(80) + "\nso few words here", "so few words here\n" + run(50) + "\n" + passage + "\n" + run(20), line + "\n" + run(30), line + "\n" + run(30), run(100)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[4], None, ""])), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert out[0].n_removed == 0 and out[4].n_removed == 0 and out[0].text == texts[0]
    assert out[1].n_removed >= 45 and passage not in out[1].text and out[1].text.startswith(texts[1].split("\n")[0])  # four words are no line
    assert out[2].text == texts[2] and out[3].text == texts[3].split("\n")[1]  # a line that stood earlier
    assert (out[5].text, out[5].n_removed) == ("", 100)
    assert out[6].text is None and out[7].text == ""


def less_repeats(docs, n, line=linededup.LINE):
    """Texts without the words of runs of n words, and of shorter lines of at least so many, that came earlier; words deleted, and passages."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
        w = low(text)
        w = [w[a:b] for a, b in spans]
        gone = [False] * len(w) + [False]
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if run in seen:
                gone[k : k + n] = [True] * n
            seen.add(run)
        row = [text.count("\n", 0, a) for a, _ in spans]
        for a in range(len(w)):
            if a == 0 or row[a] != row[a - 1]:
                b = next((j for j in range(a, len(w)) if row[j] != row[a]), len(w))
                if line <= b - a < n:
                    run = ("line", *w[a:b])
                    if run in seen:
                        gone[a:b] = [True] * (b - a)
                    seen.add(run)
        starts = [a for a, _ in spans] + [len(text)]
        kept = "".join(text[starts[k] : starts[k + 1]] for k in range(len(w)) if not gone[k])
        kept = text[: starts[0]] + kept if w else text
        n_runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(w)))
        out[key] = (kept.rstrip(" \t\n\v\f\r") if w and gone[len(w) - 1] else kept, sum(gone), n_runs)
    return out


@pytest.mark.parametrize("flush, most", [(linededup.FLUSH, linededup.MOST), (500, 700)])
def test_line_dedup_by_brute_force(spark, monkeypatch, flush, most):
    """Passages of each length from 15 words up, within otherwise different lines and as lines, in any case; some first stood at several places over a part of their length only."""
    monkeypatch.setattr(linededup, "FLUSH", flush)
    monkeypatch.setattr(linededup, "MOST", most)
    rng = random.Random(7)
    run = lambda n: [str(rng.randrange(10**6)) + rng.choice("abc") for _ in range(n)]
    texts, planted = [], []
    for n in [*range(15, 34), 60, 300] * 3:
        p = run(n)
        if n % 3 == 0:  # its first half stood in an earlier text, with other words after it
            texts.append(" ".join(run(9) + p[: n // 2] + run(9)))
        sep = "\n" if n % 2 else " "
        texts.append(" ".join(run(rng.randrange(40))) + sep + " ".join(p) + sep + " ".join(run(rng.randrange(40))))
        texts.append("  ".join(run(rng.randrange(1, 40))) + sep + "\t".join(p).upper() + sep + " ".join(run(rng.randrange(1, 40))))
        planted.append((len(texts) - 1, n))
    texts += [" ".join(run(5)) + " odd\u2003", " ".join(run(20)) + "\u2003 \n", texts[1] + " its own end\u2003", texts[2] + "\u2003 \n"]  # spaces that are letters, and spaces at the end
    texts += ["again " * 600, "Again\n" * 20, texts[1] + " " + texts[1]]
    docs = list(enumerate(texts))
    want = less_repeats(docs, linededup.WORDS)
    assert all(want[k][1] == (n if n >= linededup.WORDS or n % 2 else 0) for k, n in planted)  # odd ones are lines
    made = spark.createDataFrame(docs + [docs[3]], "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in linededup.dedup(made).collect()}
    assert out == want


def test_line_dedup_of_documents(spark, small):
    docs = sorted(rows(spark, small))
    out = {r.doc_id: (r.text or "", r.n_removed, r.n_runs) for r in linededup.dedup(common.documents(spark, small)).collect()}
    assert len(out) == len(docs) and out == less_repeats(docs, linededup.WORDS)


def test_short_lines_go_if_asked_to(spark, small):
    """With line=1 every repeated line goes, however short; with the default, lines of up to four words stay."""
    docs = sorted(rows(spark, small))
    docs += [(900, "Cookie policy accepted here\n" * 3 + "one"), (901, "two\nCookie policy accepted here\nCookie policy accepted here"), (902, "one")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: (r.text or "", r.n_removed, r.n_runs) for r in linededup.dedup(made, line=1).collect()}
    assert out == less_repeats(docs, linededup.WORDS, 1) and out[901] == ("two", 8, 1) and out[902] == ("", 1, 1)


def test_license_templates(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "the apache licenses"), (3, "SPDX-License-Identifier: MIT"),
        (4, "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
        (5, "licensed under cc by-sa 4.0; MIT license, mit license"), (6, "Copyright (c) 2020 Some Body Inc. All rights reserved")], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [out[k].labels for k in range(1, 7)] == ["apache,apache-2.0", "", "spdx", "gpl,gpl-3.0", "cc-by,cc-by-sa-4.0,mit", "all-rights-reserved,copyright"]
    assert (out[5].n_base, out[5].first_word, out[5].last_word, out[5].base_labels) == (3, 2, 9, "cc-by,mit")
    assert out[2].score == 0 and out[1].score == 1


def test_license_base_by_brute_force(spark, small):
    texts = dict(rows(spark, small))
    for r in QUERIES["op9_license_scans"](spark, small).collect():
        w = WORDS.findall(low(texts[r.doc_id]))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places
            else None, ",".join(sorted({x for _, x in places})))


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def base_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_pii_base_by_brute_force(spark):
    rng = random.Random(3)
    parts = [*"a1 2.@+-()9é𝒜%_\n", "4444", "1.2.3", "@b.co", "+1 (017) 555-771 ", "4539 1488 0343 6467", 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)] + ["1" * 50_000, "a." * 20_000 + "@", "a@b.co " * 3000, "1." * 10_000]
    spans = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in pii.found(spans, pii.fitted(spans)).collect():
        base = base_spans(texts[r.doc_id])
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_pii_finds_secrets_and_runs_no_python(spark, small):
    spans = pii.candidates(common.documents(spark, small))
    out = pii.found(spans, pii.fitted(spans))
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    texts = dict(rows(spark, small))
    with_token = {k for k, t in texts.items() if re.search(r'token = "[0-9a-f]{40}"', t)}
    assert with_token <= {r.doc_id for r in out.where("spans LIKE '%secret:%'").collect()}


def test_em_trusts_labelers_that_agree():
    post = pii.reliabilities({(0, "1111"): 80, (0, "0020"): 60, (0, "1020"): 2, (0, "0111"): 2})
    assert post[0, "1111"] > 0.9 and post[0, "0020"] < 0.1


def test_quality_on_held_out(spark):
    path = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, path).collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet").where("quality IS NOT NULL").collect()
    held = [(out[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_pipeline_rows_without_doc_id(spark, tmp_path):
    """Decisions of the pipeline's stages go back to rows with null and repeated doc_ids."""
    import corpus_pipeline as P

    rng = random.Random(5)
    run = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, leak = run(80), run(80), run(80), run(80), run(14)
    near = lambda x: x + " " + run(2)
    rows_ = [(1, a), (None, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (2, c), (2, d), (3, d), (4, near(a)), (None, None), (None, " "), (5, ""), (5, "")]
    made = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in P.near_duplicates(spark, made, "").collect()]
    of_b = [x for x in kept if x[0] is None and x[1] and x[1].startswith(b)]
    assert len(of_b) == 1
    assert Counter(x for x in kept if x not in of_b) == Counter([(1, a), (2, c), (2, d), (None, None), (None, " "), (5, "")])

    spark.createDataFrame([("i", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows_ = [(None, a + " " + leak), (None, a), (1, b), (1, b + " " + leak), (2, leak), (None, None)]
    made = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.text) for r in P.decontamination(spark, made, str(tmp_path)).collect()) == Counter([(None, a), (1, b), (None, None)])


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = common.documents(spark, small)
    columns, n = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = common.table(stage(spark, docs, small), name)
        assert docs.columns == columns
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0
    again = {r.doc_id: r.component_id for r in jaccard.similar(docs).collect()}
    assert not decontaminate.report(decontaminate.contamination(docs, common.documents(spark, small, "benchmark"))).where("contaminated").count()
    assert all(k == c for k, c in again.items())
    assert P.run(spark, small).select("doc_id").distinct().count() == n[-1]


def test_genetic_packing_beats_best_fit():
    """Triplets that fill bins exactly are hard for best fit decreasing."""
    rng = random.Random(1)
    sizes = []
    for _ in range(60):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    greedy = packing.refill([], [], list(range(180)), sizes, 1000)
    best = None
    for k in range(4):
        best = packing.evolve(sizes, 1000, k, [best] if best else [], 30, 8)
        assert sorted(i for b in best[0] for i in b) == list(range(180))
        assert best[1] == [1000 - sum(sizes[i] for i in b) for b in best[0]] and min(best[1]) >= 0
    assert len(best[0]) <= 63 < len(greedy[0])


def test_packing_over_many_shards(spark):
    """Equal rows spread over shards, every row is packed once, and what small shards lose is made good across them."""
    rng = random.Random(3)
    rows_ = [(None, 0, 100, 7)] * 300 + [(k, 0, rng.randint(40, 900), k) for k in range(500)]
    cut = common.table(spark.createDataFrame(rows_, "doc_id long, piece int, length long, ids_crc32 long").repartition(3), "cut")
    out = packing.pack(cut, shard=100, worst=6).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == sorted((str(r[0]), r[2]) for r in rows_)
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024
    assert len(bins) <= len(packing.pack(cut, shard=100, worst=0).select("sequence_id").distinct().collect())
    assert len(bins) <= -(-sum(r[2] for r in rows_) // 1024) + 3


def test_whole_licence_notices(spark):
    """Every template's wording, with and without its optional regions and with long holders, has its label; a mandatory word less and it hasn't."""
    plain = lambda t: re.sub(r"<<(?:begin|end)Optional>>", "", t)
    short = lambda t: re.sub(r"<<beginOptional>>(?:(?!<<(?:begin|end)Optional>>).)*<<endOptional>>", " ", t, flags=re.S)

    def without(t):
        while (s := short(t)) != t:
            t = s
        return t

    values = {"year": "2019", "version": "3", "id": "mit", "scheme": "https"}
    fill = lambda t: re.sub(r'<<var;name="([a-z]+)"[^>]*>>', lambda m: values.get(m[1], "The Regents and Contributors of a University with a Very Long Name"), t)
    texts = [(2 * k + j, label, "Some words before. " + fill(f(t)) + " And after.") for k, (label, t) in enumerate(license_texts.TEMPLATES) for j, f in enumerate((plain, without))]
    out = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame([(k, t) for k, _, t in texts], "doc_id long, text string")).collect()}
    for k, label, text in texts:
        assert label in out[k], (label, text)
    broken = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame([(1,
        fill(plain(dict(license_texts.TEMPLATES)["mit-full"])).replace("MERCHANTABILITY", "merchants"))], "doc_id long, text string")).collect()}
    assert "mit-full" not in broken[1] and "mit-text" in broken[1]
    with pytest.raises(ValueError):
        licenses.Automaton('<<beginOptional>>maybe<<endOptional>><<var;name="x";match=".+">>')


def test_secrets_and_numbers_are_found_once(spark, small):
    """All planted secrets are among the spans, and no span lies in another of its kind."""
    path = small.replace("0.001", "0.01")
    texts = dict(rows(spark, path))
    planted = {k: [m.span(1) for m in re.finditer(r'(?:token|key|secret) = "([0-9a-f]{32,})"', t)] for k, t in texts.items()}
    hit = total = 0
    for r in QUERIES["op8_pii"](spark, path).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert r.n_spans == len(spans)
        for p, q in zip(sorted(spans), sorted(spans)[1:], strict=False):
            assert p[0] != q[0] or p[2] <= q[1]
        total += len(planted[r.doc_id])
        hit += sum(any(k == "secret" and a <= x and y <= b for k, a, b in spans) for x, y in planted[r.doc_id])
    assert total > 5 and hit >= 0.9 * total


def test_scores_are_the_average_of_vectors(spark):
    """The classifier's scores by a plain loop over each text's features."""
    rng = np.random.default_rng(1)
    table, bias = rng.normal(0, 1, (quality.SIZE, 2)), np.array([0.2, -0.1])
    texts = ["a few words words words here", "", None, "é漢 x", "one"]
    out = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (table, bias)).collect()}
    for k, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        (ids, w), = quality.counted(data, np.array([0, len(data)]))
        z = bias + sum((table[i] * x for i, x in zip(ids, w, strict=True)), np.zeros(2))
        assert abs(out[k] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_sample_is_bounded_and_alike(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k % 60} " * 20) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1)], "doc_id long, quality int")
    x, y = quality.sample(docs.repartition(3), labels, "quality", rows=25)
    a, b = quality.sample(docs.repartition(5), labels, "quality", rows=25)
    assert len(x) == len(a) == 25 and y.tolist() == b.tolist() and all((p[0] == q[0]).all() for p, q in zip(x, a, strict=True))
    some, _ = quality.sample(docs, labels, "quality", rows=25, size=sum(p.nbytes + q.nbytes for p, q in x) // 2)
    assert 0 < len(some) < 25


def test_no_features_reach_the_driver(spark, monkeypatch):
    """The classifier is trained on its sample in a task: the only bytes that the driver gets are the model's, which is that of the sample."""
    docs = spark.createDataFrame([(k, f"text {k % 30} of words " * 20) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    want, bias = quality.train(*quality.sample(docs, labels, "quality"))
    frame, got = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    quality.classify(docs, labels)
    assert sum(len(v) for rows in got for r in rows for v in r if isinstance(v, bytes | bytearray)) == want.nbytes + bias.nbytes
    table, found = quality.fitted(docs, labels, "quality")
    assert np.allclose(table, want, atol=1e-3) and np.allclose(found, bias, atol=1e-4)


def test_pipeline_loses_no_text(spark, small):
    """Line dedup cuts only what stands at its first place in what it returns, also where most of a document is repeated; no near copies are left in the end."""
    import corpus_pipeline as P

    rng = random.Random(3)
    run = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    x, y, z = run(60), run(20), run(60)
    docs = spark.createDataFrame([(1, x), (2, f"{x} {y}"), (3, f"{y} {z}"), (4, x), (5, f"{x}\n{y}")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in P.line_dedup(spark, docs, small).collect()}
    assert set(out) == {1, 2, 3} and all(w in " ".join(out.values()).split() for w in f"{x} {y} {z}".split())
    cut = lambda t: {w for w in re.split(r"[ \t-\r]+", low(t)) if w}
    docs = common.documents(spark, small)
    stages = dict(P.STAGES)
    after = common.table(stages["line_dedup"](spark, docs, small), "lines")
    assert set().union(*(cut(r.text) for r in docs.collect())) == set().union(*(cut(r.text) for r in after.collect()))
    left = common.table(stages["ngram_jaccard_join"](spark, after, small), "near").collect()
    sets = {r.doc_id: set(zip(*(w[k:] for k in range(5)))) if len(w := re.findall(r"[^ \t-\r]+", low(r.text))) >= 5 else {tuple(w)} - {()} for r in left}
    by = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            by[g].add(k)
    pairs = Counter(p for ks in by.values() for p in itertools.combinations(sorted(ks), 2))
    assert not [p for p, n in pairs.items() if 100 * n >= 75 * len(sets[p[0]] | sets[p[1]])]


def test_packing_beats_best_fit(spark):
    """Triplets that fill sequences exactly, through pack(): fewer sequences than best fit decreasing needs, whole and within size."""
    rng, sizes = random.Random(17), []
    for _ in range(60):
        a = rng.randrange(260, 500)
        b = rng.randrange(260, min(500, 1024 - a - 200))
        sizes += [a, b, 1024 - a - b]
    rng.shuffle(sizes)
    packing.best_fit(bins := [], [], sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, 1024)
    cut = common.table(spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long"), "cut")
    rows_ = packing.pack(cut).collect()
    assert sorted((r.doc_id, r.length) for r in rows_) == list(enumerate(sizes))
    by = defaultdict(list)
    for r in rows_:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) < len(bins) and len(by) <= 62
