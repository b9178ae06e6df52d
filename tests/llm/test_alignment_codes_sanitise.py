"""Alignment, vector codes and sanitisation against brute force on whole rows."""

import functools
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomsift.llm import alignment, bpe, queries, sanitise, vector_codes

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- alignment


class Both:
    def __init__(self):
        self.a = Tokenizer.from_file(bpe.vocabulary())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary("piece_bpe_32k.model"))
        to_byte = bpe._visible()
        self.a_bytes = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """(id, start, end) of both, or nothing."""
        if not text:
            return [], []
        out = []
        for ids, spell in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.b_bytes)):
            at, rows = 0, []
            for i in ids:
                rows.append((i, at, at + len(spell(i))))
                at = rows[-1][2]
            if b"".join(spell(i) for i in ids) != (" " + text).encode():
                return [], []
            out.append(rows)
        return tuple(out)


def aligned_by_hand(texts):
    both, links, out = Both(), {}, {}
    total = Counter()
    for key, text in texts.items():
        a, b = both.tokens(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        ends = [defaultdict(list), defaultdict(list)]
        for side, rows in zip(ends, (a, b)):
            for i, _, e in rows:
                side[e].append(i)
        links[key] = [(x, y) for e in cuts for x in ends[0][e] for y in ends[1][e]]
        total.update(links[key])
        groups, low = [], 0
        for e in cuts if len(a) < 1000 else []:
            part = lambda rows: ",".join(str(i) for i, _, f in rows if low < f <= e)  # noqa: B023, E731
            groups.append(part(a) + "|" + part(b))
            low = e
        overlaps = sum(max(x[1], y[1]) < min(x[2], y[2]) for x in a for y in b) if len(a) < 300 else None
        out[key] = [len(a), len(b), len(cuts), len(links[key]), overlaps, ";".join(groups) if len(a) < 1000 else None]
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    for key, own in links.items():
        out[key] += [sum(total[p] == best[p[1]] for p in own), sum(total[p] for p in own)]
    return out


@pytest.fixture(scope="module")
def odd_texts(corpus):
    out = {i: t for i, t in corpus if i is not None}
    odd = [" ", "  ", "a ", "a  ", " a", "▁ a▁b", "a▁ b", "<s> </s> <unk> <0x41> <|endoftext|>", "x  y   z   w", "tab\t\t x\n\n y \r\n", "é é ﬁ 가", "\x00 a\x00b", "we'll  don't 'S", "\U0001f600 \U0001f469‍\U0001f4bb ok", "\x1c x\x1f y", "ab" * 700, "nospace" * 60 + "ß" * 40]
    out.update({80_000 + i: t for i, t in enumerate(odd)})
    out[81_000] = " ".join(f"w{i % 50}ü" for i in range(30_000))
    return out


def test_alignment(spark, odd_texts):
    rows = [(i, t, "x", 3) for i, t in odd_texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n long").repartition(3)
    got = {r.doc_id: r for r in alignment.align_documents(docs, keep_groups=True).collect()}
    want = aligned_by_hand(odd_texts)
    assert got.keys() == want.keys()
    for key, (n_a, n_b, n_groups, n_links, overlaps, groups, n_best, count_sum) in want.items():
        r = got[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum), odd_texts[key][:80] if odd_texts[key] else key
        assert overlaps is None or r.n_overlaps == overlaps
        if groups is not None:
            assert r.groups == groups and r.groups_sha256 == (sha(groups) if groups else "")
    assert sum(not w[0] for w in want.values()) > 3


def test_alignment_blocks(spark, odd_texts, monkeypatch):
    """The same whatever blocks documents lie in, and when a worker's segments are dropped."""
    docs = spark.createDataFrame([(i, t) for i, t in odd_texts.items() if i != 81_000], "doc_id long, text string")
    one = sorted(alignment.align_documents(docs.coalesce(1)).collect())
    two = sorted(alignment.align_documents(docs.repartition(7)).collect())
    assert one == two
    tool = alignment.Aligner(bpe.vocabulary(), bpe.vocabulary("piece_bpe_32k.model"))
    texts = [t for i, t in odd_texts.items() if t and i != 81_000]
    whole = alignment._encoded(list(range(len(texts))), texts, tool, True)
    monkeypatch.setattr(alignment, "MOST_SEGMENTS", 5)
    said = [alignment._encoded([i], [t], tool, True).column("sha")[0].as_py()[0] for i, t in enumerate(texts)]
    assert said == whole.column("sha")[0].as_py()


def test_alignment_null_ids_repeats_and_empty(spark, docs, corpus, empty):
    rows = alignment.align_documents(docs).collect()
    assert len(rows) == len(corpus) and sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in corpus)
    assert alignment.align_documents(empty).collect() == []
    assert alignment.align_documents(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("n_a")).first()[0] == 0


# --- vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    books = [[r[2][p * size : (p + 1) * size] for r in sorted(kept)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                x = v[p * size : (p + 1) * size]
                own[nearest(x, books[p])[1]].append(x)
            for i, xs in own.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    done = {}
    for i, lab, v in kept:
        found = [nearest(v[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        done[i] = ("".join(f"{at:02x}" for _, at in found), sum(d for d, _ in found), lab)
    per = Counter()
    for _, e, lab in done.values():
        per[lab] += e
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return {i: (code, e, per[lab]) for i, (code, e, lab) in done.items()}, sha(text), books


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # Few values, so that many entries are equally near.
        v = (rng.integers(-3, 4, 8) / 1024 * rng.choice([1, 1, 40])).astype(np.float32).tolist()
        rows.append((1000 - 3 * i, v, None if i % 7 == 0 else i % 3))
    rows += [(5001, None, 1), (5002, [1.0] * 7 + [None], 1), (5003, [float("nan")] * 8, None), (5004, [1.0] * 7 + [float("-inf")], 2)]
    return rows


KIND = "vec_id long, embedding array<float>, label int, code string, _v int"


def test_vector_codes(spark, tmp_path):
    rows = vectors(300)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(3)
    for entries in (256, 20):
        want, digest, books = codes_by_hand(rows, entries=entries)
        out, found = vector_codes.product_codes(frame, entries=entries)
        assert {r.vec_id: (r.code, r.error, r.label_error) for r in out.collect()} == want
        assert vector_codes.digest(found) == digest
        spelt = {r.vec_id: r.vector for r in vector_codes.decode(out, found).collect()}
        code = want[1000][0]
        assert spelt[1000] == [c / 1024 for p in range(4) for c in books[p][int(code[2 * p : 2 * p + 2], 16)]]
    frame.drop("code", "_v").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ran = queries.op12_vector_codes(spark, str(tmp_path))
    asked = con.execute(vector_codes.SQL).fetch_df()
    assert sorted(map(tuple, asked[ran.columns].itertuples(index=False))) == sorted(map(tuple, ran.collect()))


def test_tree_visits_equal_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 5, 8, 9, 100, 256):
        book = rng.integers(-2, 3, (n, 3))
        x = rng.integers(-3, 4, (500, 3))
        at, far = vector_codes.Tree(book).nearest(x)
        all_ = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (at == all_.argmin(1)).all() and (far == all_.min(1)).all()


def test_vector_codes_odd_rows(spark):
    rows = [(None, [1.0] * 8, 1), (1, [0.5] * 8, 1), (1, [0.5] * 8, None), (2, [0.5] * 8, 4), (3, [1.0] * 4, 4), (4, [], 4), (5, [3e38] * 8, None), (6, [-0.00001] * 8, 1)]
    out, books = vector_codes.product_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND))
    got = sorted(((r.vec_id is not None, r.vec_id or 0, r.code, r.error, r.label_error) for r in out.collect()), key=repr)
    assert len(got) == 8 and books.shape == (4, 5, 2)
    assert {g[1] for g in got if g[2] is None} == {3, 4, 5}
    assert sum(g[3] or 0 for g in got) == 0 and books[0, 3].tolist() == [-1, -1]
    none, books = vector_codes.product_codes(spark.createDataFrame([], KIND))
    assert none.collect() == [] and books.size == 0


# --- sanitisation

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


@functools.cache
def base_by_hand(text):
    """(kind, start, end, gap before, gap after)."""
    out = []
    for kind, pattern in BASE.items():
        every = list(re.finditer(pattern, text or ""))
        for k, m in enumerate(every):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            low, high = every[k - 1].end() if k else 0, every[k + 1].start() if k + 1 < len(every) else len(text)
            name = {"email": m[0].lower(), "ip": ".".join(str(int(p)) for p in m[0].split(".")) if kind == "ip" else ""}.get(kind, digits)
            out.append((kind, f"{kind}:{name}", m.start(), m.end(), low, high))
    return out


@functools.cache
def contexts_by_hand(text):
    out = []
    word = re.compile(r"[^\W\d_]{3,}")
    for _, entity, start, end, low, high in base_by_hand(text):
        side = [w for w in word.finditer(text[max(low, start - 120) : start])]
        base = max(low, start - 120)
        near = [w for w in side if not (w.start() == 0 and start - base == 120)][-8:]
        out += [(entity, w[0].lower(), base + w.start(), base + w.end()) for w in near]
        tail = text[end : min(high, end + 120)]
        near = [w for w in word.finditer(tail) if not (w.end() == 120 and len(tail) == 120)][:8]
        out += [(entity, w[0].lower(), end + w.start(), end + w.end()) for w in near]
    return out


def spans_by_hand(texts):
    distinct = {t or "" for t in texts}
    n_entity, n_both, n_term = Counter(), Counter(), Counter()
    for t in distinct:
        n_entity.update({e for _, e, *_ in base_by_hand(t)})
        n_both.update({c[:2] for c in contexts_by_hand(t)})
        n_term.update({w for w in re.split(r"[\W\d_]+", t.lower())})
    told = {}
    for (e, t), n in n_both.items():
        if n >= 3 and n_entity[e] < len(distinct):
            share = math.log(n * len(distinct) / (n_term[t] * n_entity[e])) / math.log(len(distinct) / n_entity[e])
            told[e, t] = share
    out = []
    for t in texts:
        base = [(k, a, b) for k, _, a, b, *_ in base_by_hand(t)]
        worst = defaultdict(float)
        for e, w, a, b in contexts_by_hand(t):
            worst[a, b] = max(worst[a, b], told.get((e, w), 0))
        extra = sorted(("removed" if s >= 0.95 else "generalised", a, b) for (a, b), s in worst.items() if s >= 0.85 and not any(x < b and a < y for _, x, y in base))
        out.append((base, extra))
    return out


@pytest.fixture(scope="module")
def personal():
    rows = ["", None, "a@b.c_d@e.f x", "a@b@c.d a@b..c me@x.y.", "1.2.3.4.5 256.1.1.1 1.2.3 000.01.255.007 1.1.1.1111", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 1 2 3", "+1 (202) 555-0143, +12 3 +49.30.1234567- ++4412345678", "4111111111111111 4111111111111111", "x" * 30_000 + "@y.z", "1" * 3000 + " " + "a." * 5000 + "@" + "b." * 5000 + "c", "u@v.w " * 700, "😀 é j@k.l 😀 1.1.1.1", "8.8.8.8\n+123456789"]
    for i in range(40):
        rows.append(f"Ask Zorblatt the curator, mail zed@corp.example or ring +1 202 555 01{i:02d} about item {i} today the end {'plain ' * (i % 5)}")
        rows.append(f"the end of the plain day number {i} about item and mail or ring today")
        rows.append("the curator said plain things" + f" {i}" * (i % 3))
        rows.append(f"Quill writes from 10.0.0.{i % 2} the other plain day {i}")
    return rows + rows[-8:] + [rows[20]] * 30


def test_sanitise(spark, personal):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(personal)], "doc_id long, text string, _key string, base array<int>").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in sanitise.personal_spans(docs).collect()}
    want = spans_by_hand(personal)
    assert got == {i: [*base, *extra] for i, (base, extra) in enumerate(want)}
    named = {t[a:b].lower() for t, (_, extra) in zip(personal, want) for _, a, b in extra}
    assert "zorblatt" in named and "the" not in named and "plain" not in named
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert clean[2] == "[email][email] x" and clean[0] == ""
    assert not any("zorblatt" in t.lower() or "zed@" in t for t in clean.values())
    assert clean[14] == personal[14]


def test_sanitise_query(spark, personal, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(personal)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = spans_by_hand(personal)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ran = queries.op13_sanitise(spark, str(tmp_path))
    asked = con.execute(sanitise.SQL).fetch_df()
    assert sorted(map(tuple, asked[ran.columns].itertuples(index=False))) == sorted(map(tuple, ran.collect()))
    for r in ran.collect():
        base, extra = want[r.doc_id]
        kinds = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in BASE)
        assert r.base_sha256 == sha(said(base)) and r.spans == said([*base, *extra])


def test_sanitise_null_ids_repeats_and_empty(spark, docs, corpus, empty):
    rows = sanitise.personal_spans(docs).collect()
    assert len(rows) == len(corpus) and sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in corpus)
    assert sanitise.personal_spans(empty).collect() == [] and sanitise.sanitised(empty).collect() == []
    nulls = spark.createDataFrame([(None, "me@x.yz"), (None, "1.1.1.1"), (None, None)], "doc_id long, text string")
    assert sorted(r.text for r in sanitise.sanitised(nulls).collect()) == ["", "[email]", "[ip]"]


def test_sanitise_is_native(spark, docs):
    plan = sanitise.personal_spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_running_sums_over_strides(spark):
    row = spark.range(1).select(sanitise._running(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: x % 7)).alias("x")).first()
    assert row.x == np.cumsum([i % 7 for i in range(1, 2001)]).tolist()
