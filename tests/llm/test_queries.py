"""The contract columns of the registered queries, against brute force over whole texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomsift.llm import bpe, bpe_table, fingerprints, jaccard, kernels, queries, substring

SEP = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda raw: hashlib.sha256(raw).hexdigest()


def thue_morse(n):
    """Two words of ``n`` letters that polynomial hashes modulo a power of two can't tell apart."""
    s, t = "a", "b"
    while len(s) < n:
        s, t = s + t, t + s
    return s, t


@pytest.fixture(scope="module")
def texts(corpus):
    """id to text: the corpus with one text per id, words that hash badly, and very long texts."""
    out = {i: t for i, t in corpus if i is not None}
    for k, n in enumerate((64, 512, 1024, 2048, 4096)):
        s, t = thue_morse(n)
        around = [f"n{k}w{j}" for j in range(29)]
        for j, word in enumerate((s, t)):
            out[50_000 + 10 * k + j] = word
            out[60_000 + 10 * k + j] = " ".join([*around[:14], word, *around[14:]])
    passage = " ".join(f"long{j % 977}x{j}" for j in range(60_000))
    out[70_001] = passage
    out[70_002] = "start " + passage[200_000:] + " end"
    out[70_003] = "ab" * 300_000
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def encoded(texts, tokenizer):
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_op1(spark, sf_dir, texts):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    got = rows_of(queries.op1_secret_scan(spark, sf_dir))
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = []
        for order, (kind, pattern, group, least) in enumerate(kinds):
            found = [m for m in pattern.finditer(t or "") if len(m[group]) >= least]
            assert got[i][f"n_{kind}"] == len(found)
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in found]
        assert got[i].base_sha256 == sha(",".join(x for *_, x in sorted(spans)).encode())


def test_op3(spark, sf_dir, texts):
    n, first = 20, {}
    for i, t in sorted(texts.items()):
        words = SEP.findall(t or "")
        for p in range(len(words) - n + 1):
            first.setdefault(tuple(words[p : p + n]), (i, p))
    got = rows_of(queries.op3_substring_dedup(spark, sf_dir))
    for i, t in texts.items():
        words = SEP.findall(t or "")
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - n + 1):
            if first[tuple(words[p : p + n])] != (i, p):
                gone[p : p + n] = True
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), int(gone.sum()), sha(kept.encode())), i
    assert got[60_020].n_removed == got[60_021].n_removed == 0 and got[70_002].n_removed > 30_000


def test_op4(spark, sf_dir, texts):
    got = rows_of(queries.op4_fingerprints(spark, sf_dir))
    order = sorted(texts, reverse=True)
    same = defaultdict(set)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha((t[: len(t) - cut] + after[:cut]).encode())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        same[t].add(got[i].fingerprint)
        if t == after:
            assert got[i].near_next == 1
    assert all(len(v) == 1 for v in same.values()) and len({got[i].fingerprint for i in (60_020, 60_021)}) == 2
    assert 0.6 < got[70_001].near_edited < 0.72, "two thirds of the anchors stay, none is left out"


def test_op4_over_stretches(spark, monkeypatch):
    """Next documents across buckets and stretches of buckets, where most are empty."""
    monkeypatch.setattr(fingerprints, "BUCKET", 3)
    monkeypatch.setattr(fingerprints, "STRETCH", 2)
    ids = [-9, -1, 0, 1, 2, 5, 6, 7, 30, 31, 100, 1000, 1001, 1002, 5000]
    docs = spark.createDataFrame([(i, f"text {i} " * 3) for i in ids], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.compare_with_edit(docs).collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        t, after = f"text {i} " * 3, f"text {order[(k + 1) % len(order)]} " * 3
        assert got[i] == sha((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode())


def test_op6(spark, sf_dir, texts, encoded, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_table, "HEAD_WORDS", 200)
    got = rows_of(queries.op6_bpe(spark, sf_dir))
    for i, ids in encoded.items():
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False).encode())


def test_op6_decodes_by_pieces(spark, monkeypatch):
    """A piece that spells something else shows in the decoded text, in frequent and in joined words."""
    data, at = bpe.pieces(bpe.vocabulary())
    raw = [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:])]
    hello = Tokenizer.from_file(bpe.vocabulary()).encode("Hello", add_special_tokens=False).ids
    raw[hello[0]] = b"<" + raw[hello[0]] + b">"
    changed = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    monkeypatch.setattr(bpe_table, "pieces", lambda path: changed)
    docs = spark.createDataFrame([(1, "Hello x Hello"), (2, "y <|endoftext|>Hello"), (3, "no")], "doc_id long, text string")
    for head in (1, 1000):
        monkeypatch.setattr(bpe_table, "HEAD_WORDS", head)
        got = {r.doc_id: r.decoded for r in bpe_table.encode_documents(docs).collect()}
        want = raw[hello[0]].decode()
        assert got[3] == "no" and got[1].startswith(want) and got[2].count(want) == 1


def test_op7(spark, sf_dir, texts):
    for i, r in rows_of(queries.op7_transport_stream(spark, sf_dir)).items():
        raw = (texts[i] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert r.media_bytes % 188 == 0 and r.media_bytes > len(payload) and r.continuity_errors == 0 and r.units


def test_op8(spark, sf_dir, encoded):
    sizes = Counter(len(ids) for ids in encoded.values())
    got = {r.n_tokens: r for r in queries.op8_token_counts(spark, sf_dir).collect()}
    assert {n: r.n_docs for n, r in got.items()} == sizes
    for n, r in got.items():
        assert r.truncated_total == sum(min(k, n) * c for k, c in sizes.items()) and r.docs_at_least == sum(c for k, c in sizes.items() if k >= n)


def test_op9(spark, sf_dir, texts):
    sets = {}
    for i, t in texts.items():
        w = SEP.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links, ids = Counter(), sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 100 * small >= 80 * large:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 80 * (small + large - common):
                    links.update((i, j))
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    got = rows_of(queries.op9_jaccard_join(spark, sf_dir))
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == {i: (len(sets[i]), find(i), links[i]) for i in sets}
    assert got[50_020].component_id != got[50_021].component_id


def test_op10(spark, sf_dir, encoded):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op10_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in encoded.items():
        ids, at = [*ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
        assert at <= 2048 and sum(r.loss_tokens for r in parts) <= 1792 and len(parts) <= 256
    assert sum(0 if s & (s - 1) == 0 else 2048 - s for s in sizes) == 0 and len(encoded[70_001]) > 100_000
    assert any(r.loss_tokens < r.length for parts in sequences.values() for r in parts)


def test_op2_and_op5_run_over_all(spark, sf_dir, texts):
    assert set(rows_of(queries.op2_license_scan(spark, sf_dir))) == set(texts)
    got = rows_of(queries.op5_quality(spark, sf_dir))
    assert set(got) == set(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_colliding_hashes_are_found_out(monkeypatch):
    """Where hashes of different words meet, words decide: here a hash has two bits."""
    weak = lambda data, start, end: np.asarray(real(data, start, end) & np.uint64(3))
    real = kernels.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", weak)
    monkeypatch.setattr(kernels, "span_hashes", weak)
    table = bpe.WordTable()
    words = ["a", "b", "c", "dd", "a", "é", "b", "x" * 100, "x" * 99 + "y", "c"]
    data = np.frombuffer("".join(words).encode() + bytes(8), np.uint8)
    spans = bpe.Spans(data, np.array([len(w.encode()) for w in words]))
    number = table.numbers(spans)
    names = table.words()
    assert [names[n] for n in number] == words and table.n == len(set(words)) and (table.numbers(spans) == number).all()
    other = bpe.Spans(np.frombuffer(b"azq" + bytes(8), np.uint8), np.array([1, 1, 1]))
    assert table.numbers(other, add=False).tolist()[1:] == [-1, -1]
    coder = bpe.Encoder(bpe.vocabulary())
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    texts = ["one two three one four", "five  six\nseven one"]
    got = [ids[a:b].tolist() for _, ids, o in coder.batches(texts) for a, b in zip(o[:-1], o[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    rng = np.random.default_rng(3)
    bases = [[f"w{x}" for x in rng.integers(0, 9, 24)] for _ in range(5)]
    bodies = [" ".join(base[:at] + [f"v{k}"] * (at % 3 == 0) + base[at:]) for k in range(60) for base, at in [(bases[k % 5], int(rng.integers(0, 24)))]]
    (w,) = kernels.words(pa.array(bodies), limit=1 << 62)
    count = np.diff(w.first) - substring.WINDOW + 1
    n = len(bodies)
    block = substring.Block(np.append(w.data, np.zeros(8, np.uint8)), w.start, w.end - w.start, w.hashes(), w.first[:-1], count, np.zeros(n, np.uint64), np.arange(n), np.arange(n), np.zeros(n, np.int64))
    (ids, _, pos, size, *_), free = block.rows()
    first, want = {}, set()
    for i, body in enumerate(bodies):
        parts = body.split()
        for p in range(len(parts) - substring.WINDOW + 1):
            if first.setdefault(tuple(parts[p : p + substring.WINDOW]), (i, p)) != (i, p):
                want.add((i, p))
    assert {(int(i), int(p) + k) for i, p, s in zip(ids, pos, size) for k in range(s)} == want and (~free).sum() == len(want) > 0


def test_links_compare_words():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 3, 5, 7]), pa.array([2, 4, 6, 8]), pa.array(["a b c d e f", "x y", "x y", "A b c d e f"]), pa.array(["a b c d e f", "x y", "x z", "a  b\nc d e f g"])], names=["x", "y", "tx", "ty"])
    got = [(r["x"], r["y"]) for b in jaccard._links(iter([batch])) for r in b.to_pylist()]
    assert got == [(1, 2), (3, 4)]


def test_longest_match_is_taken():
    """A factor is the longest earlier match, not the first one found."""
    w = lambda a, b: " ".join(f"w{x}" for x in range(a, b))
    bodies = [w(0, 21) + " other", w(0, 30), w(0, 30) + " tail"]
    (words,) = kernels.words(pa.array(bodies), limit=1 << 62)
    n = len(bodies)
    count = np.diff(words.first) - substring.WINDOW + 1
    block = substring.Block(np.append(words.data, np.zeros(8, np.uint8)), words.start, words.end - words.start, words.hashes(), words.first[:-1], count, np.zeros(n, np.uint64), np.arange(n), np.arange(n), np.zeros(n, np.int64))
    (ids, _, pos, size, refs, starts), _ = block.rows()
    assert list(zip(ids, pos, size, refs, starts)) == [(1, 0, 2, 0, 0), (2, 0, 11, 1, 0)]


def test_pipeline_with_clashing_columns(spark):
    import corpus_pipeline

    rows = [(1, "one two three", "k", 1, [1]), (1, "one two three", "k", 1, [1]), (2, "one two three", "k", 2, [2]), (None, "x y", "k", 3, None), (None, "x y", "k", 3, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _of int, _row array<int>")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "one two three"), (None, "x y"), (3, None)])
    for stage in (corpus_pipeline.substring_dedup, corpus_pipeline.secret_redaction):
        out = stage(spark, docs.withColumn("n_chars", F.char_length("text").cast("long")), "")
        assert out.columns == [*docs.columns, "n_chars"] and out.count() == len(rows)
