"""Retrieval, tool calls, search results and streams against plain Python on small rows."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsift.functions.hashing import bucket_and_sign, hashed_cells
from loomsift.operators import blockmax, retrieval, scanner, toolcalls, vectors, websearch
from loomsift.sources import formats
from loomsift.streaming import stateful

# --- block-max retrieval


def words(rng, n):
    return " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(n))


def topk_by_hand(docs, queries, k):
    held = {d: set(t.split()) for d, t in docs if t and t.split()}
    df = Counter(w for s in held.values() for w in s)
    out = set()
    for q, text in queries:
        tf = Counter((text or "").split())
        scores = []
        for d, s in held.items():
            met = [w for w in tf if w in s]
            if met:
                total = sum(max(0.0, math.log((len(held) - df[w] + 0.5) / (df[w] + 0.5) + 1)) * (1 + math.log1p(tf[w])) for w in met) + 0.2 * len(met) / len(tf)
                scores.append((-round(total, 6), d))
        out |= {(q, d, rank, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("sent", [True, False])
def test_block_max(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(retrieval, "MOST_TERMS", 3)
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randrange(1, 60))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(300)] + [(2000, ""), (2001, None), (2002, "  ")]
    queries = [(i, words(rng, rng.randrange(1, 12))) for i in range(40)] + [(98, docs[3][1]), (99, ""), (100, "unheard"), (101, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    for k in (1, 5):
        got = retrieval.lexical_topk(frame, asked, k).collect()
        assert {(r.item_id, r.doc_id, r["rank"], round(r.by, 6)) for r in got} == topk_by_hand(docs, queries, k)


def test_block_max_without_rows(spark):
    docs, asked = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert retrieval.lexical_topk(some, spark.createDataFrame([], asked), 3).collect() == []
    assert retrieval.lexical_topk(some, spark.createDataFrame([(1, "zz")], asked), 3).collect() == []
    assert retrieval.lexical_topk(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], asked), 3).collect() == []


def test_blocks_are_skipped():
    """Blocks whose bound is below the best rows so far aren't opened, and the result is the same."""
    docs = [(i, ["rare"] if i < 8 else ["common"]) for i in range(40)]
    tokens = lambda part: sorted({t for _, ts in part for t in ts})
    rows = defaultdict(list)
    for at in range(0, 40, 4):
        part = docs[at : at + 4]
        rows["docs"].append([i for i, _ in part])
        rows["tokens"].append(tokens(part))
        rows["counts"].append([sum(t in ts for _, ts in part) for t in tokens(part)])
        rows["held"].append(np.array([j for t in tokens(part) for j, (_, ts) in enumerate(part) if t in ts], "<u2").tobytes())
    blocks = pa.RecordBatch.from_pydict({"docs": pa.array(rows["docs"], pa.list_(pa.int64())), "tokens": rows["tokens"], "counts": pa.array(rows["counts"], pa.list_(pa.int32())), "held": pa.array(rows["held"], pa.binary())})
    batch = blockmax.Batch(pa.table({"item_id": [7, 7], "token": ["rare", "common"], "terms": [2, 2], "w": [3.0, 0.1]}))
    best = blockmax.Best(1, 3)
    blockmax._search(blocks, batch, best)
    assert best.rows["id"].tolist() == [0, 1, 2] and best.opened == 2 and best.skipped == 8


def test_hashed_cells(spark):
    names = ["", "a", "token", "Ünïcode-日本", "x" * 300]
    idx, sign = hashed_cells(pa.array(names), 384)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", bucket_and_sign(F.col("n"), 384).alias("h")).orderBy("i").collect()
    assert [(r.h.idx, r.h.sign) for r in rows] == list(zip(idx.tolist(), sign.tolist()))


# --- tool calls and shell lines


def first_object(text):
    depth, start = 0, None
    for i, c in enumerate(text):
        if c == "{":
            start = i if start is None else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def blocks_by_hand(text):
    out = []
    while True:
        found = [(text.find(a), a, b) for a, b in toolcalls.TAGS if a in text]
        if not found:
            return out
        at, a, b = min(found)
        rest = text[at + len(a) :]
        if b in rest:
            end = rest.index(b)
            out.append(rest[:end])
            text = rest[end + len(b) :]
            continue
        call = first_object(rest[rest.index("{") :]) if rest.lstrip().startswith("call:") and "{" in rest else None
        if call is None:
            return out
        end = rest.index("{") + len(call)
        out.append(rest[:end].lstrip())
        text = rest[end:]


def nested(n):
    return '{"a": ' * n + "1" + "}" * n


SAYINGS = [
    "", "none", "{", "}", "}{", "{}", "x {a} y {b}", "} {a{b}c} {", "{{}", 'pre {"tool": "t", "args": ' + nested(500) + "} post", "😀 {é {ü}} z", "{" * 50 + "}" * 49,
    "<tool_call>call:a{x: 1}</tool_call><|tool_call>call:b{y: {z: 2}} and <tool_call>call:c{}</tool_call>", "<tool_call>call:a{x", "<|tool_call|> \n call:run{cmd: {deep: {er: 1}}} tail } <tool_call>no</tool_call>", "<tool_call><|tool_call>call:x{1}</tool_call>", "<|tool_call>plain <tool_call>call:y{}</tool_call>",
    "a <tool_call>call:q{v: " + nested(500) + "} no end", "é<tool_call>call:日本{x: 1}</tool_call>😀<tool_call>call:w{}",
]


def test_braces_and_tags(spark):
    rows = spark.createDataFrame(list(enumerate(SAYINGS)), "i int, t string").select("i", toolcalls.first_object(F.col("t")).alias("o"), toolcalls.tagged_blocks(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.o == first_object(SAYINGS[r.i]), SAYINGS[r.i][:80]
        assert r.b == blocks_by_hand(SAYINGS[r.i]), SAYINGS[r.i][:80]


def test_long_calls(spark):
    """Arguments of a megabyte, deep nesting and many braces are found, and stop nothing."""
    big = "z" * 1_000_000
    said = [
        (0, 'so {"tool": "write", "arguments": {"cmd": "' + big + '"}} end'),
        (1, '<tool_call>call:write{cmd: "' + big + '"}</tool_call>'),
        (2, '<tool_call>call:write{cmd: "' + big + '"} unclosed'),
        (3, "x " + "{}" * 100_000 + ' {"name": "n"}'),
        (4, "<tool_call>call:write{" + "a" * 200_000 + "}</tool_call>"),
        (5, 'deep {"name": "n", "args": ' + nested(500) + "}"),
        (6, " " * 300_000 + "x" + " " * 300_000),
    ]
    df = spark.createDataFrame(said, "i int, said string")
    found = {r.i: r.j for r in df.select("i", toolcalls.json_call(F.col("said")).alias("j")).collect()}
    assert json.loads(found[0])["arguments"]["cmd"] == big and found[5] == said[5][1][5:] and found[3] is None and found[6] is None
    calls = {r.i: r for r in toolcalls.tagged_calls(df).collect()}
    assert calls.keys() == {1, 2} and all(json.loads(c.arguments) == {"cmd": big} for c in calls.values())


def test_long_quotes(spark):
    big = "q" * 1_000_000
    lines = [(0, f'echo "{big}" | wc'), (1, f'echo "{big}'), (2, "echo '" + big + "' x"), (3, 'echo "' + "\\a" * 200_000 + '"'), (4, big)]
    rows = {r.i: r for r in scanner.scanned(spark.createDataFrame(lines, "i int, command string")).collect()}
    assert rows[0].words == ["echo", big, "wc"] and rows[0].pipeline and not rows[0].unbalanced_quotes
    assert rows[1].unbalanced_quotes and rows[2].words == ["echo", big, "x"] and rows[3].words == ["echo", "a" * 200_000] and rows[4].words == [big]


# --- search results


def test_json_rows(spark):
    bodies = {
        0: '[{"url": "a"}, 3, {"title": "t"}]',
        1: '{"results": [{"no": 1}], "documents": [{"href": " b "}], "other": [{"url": "x"}]}',
        2: '[[{"link": "c"}], [{"link": "d"}], {"web": {"results": [{"url": "e"}]}}]',
        3: '{"data": [{"url": ""}, {"url": 5}]}',
        4: "nothing",
        5: None,
        6: '{"data": NaN}',
        7: "[" * 5000 + "]" * 5000,
    }
    got = defaultdict(list)
    for r in websearch.json_rows(spark.createDataFrame(list(bodies.items()), "search_id long, body string")).orderBy("search_id", "pos").collect():
        got[r.search_id].append(r.fields)
    assert got == {0: [{"url": "a"}, {}, {"title": "t"}], 1: [{"href": " b "}], 2: [{"url": "e"}, {"link": "d"}, {"link": "c"}]}


def test_normalized_urls(spark):
    cases = {"HTTPS://A.Example:443#x": "https://a.example/", "http://a.b:80/P?q=1#f": "http://a.b/P?q=1", "https://U:p@Host.x:8443?y": "https://U:p@host.x:8443/?y", "https://a.b/c": "https://a.b/c"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", websearch.normalized(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == cases


# --- streams


def _requests(spark, n=400):
    rng = random.Random(2)
    rows, at = [], 0
    for i in range(n):
        at += rng.randrange(1, 40)
        rows.append((rng.randrange(6), i, float(at), 60, at * 3 // (n * 21)))
    return spark.createDataFrame(rows, "key long, event_id long, at double, ttl int, part int").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_streams_equal_batches(spark):
    requests = _requests(spark)
    parts = requests.agg(F.max("part")).first()[0] + 1
    live = stateful.drained(stateful.replayed(requests, "t", parts, F.col("part")), lambda s: stateful.cache_hits(s, "key"), "t-hits")
    assert parts > 1 and sorted(live.collect()) == sorted(stateful.cache_hits_batch(requests, "key").collect())
    reports = requests.where("event_id % 5 <> 0").select(F.col("key").alias("user_id"), "event_id", "part").selectExpr("user_id", "row_number() over (partition by user_id order by event_id) * 2 as seq", "part").withColumn("seq", F.col("seq").cast("long"))
    live = stateful.drained(stateful.replayed(reports, "s", parts, F.col("part")), stateful.sequence_gaps, "t-gaps")
    assert sorted(live.collect()) == sorted(stateful.sequence_gaps_batch(reports).collect())


def test_coalesced_writes(spark, tmp_path):
    """One write per trigger, and the last row of every key after all of them."""
    changes = _requests(spark, 120).select("key", "event_id", "part")
    path = str(tmp_path / "held")
    for stream in stateful.replayed(changes, "c", 2, F.col("part")):
        q = stateful.coalesced_writes(stream, path, "key", ["event_id"], "1 second")
        q.processAllAvailable()
        q.stop()
    want = {r.key: r.event_id for r in changes.where("part < 2").groupBy("key").agg(F.max("event_id").alias("event_id")).collect()}
    assert {r.key: r.event_id for r in stateful.persisted(spark, changes.schema, path, "key", ["event_id"]).collect()} == want
    assert len(list((tmp_path / "held").glob("write=*"))) == 2


def test_index_follower(spark, tmp_path):
    """Batches that run again change nothing; live rows are those of a fresh build, before and after compaction."""
    change = "path string, size long, mtime long, removed boolean, text string"
    batches = [
        [(f"p{i}", 1, 1, False, f"word{i} all") for i in range(20)],
        [("p1", 2, 2, False, "renewed all"), ("p2", 1, 2, True, None), ("p3", 1, 1, False, "word3 all"), ("gone", 1, 1, True, None), ("p4", 1, 2, False, "first"), ("p4", 1, 3, False, "second")],
        [(f"p{i}", 1, 9, True, None) for i in range(10, 20)],
        [("p2", 1, 9, False, "back"), ("p1", 1, 9, False, None)],
    ]
    state, reports = {}, []
    index = stateful.IndexFollower(spark, str(tmp_path / "index"))
    for number, rows in enumerate(batches):
        latest = {}
        for r in sorted(rows, key=lambda r: (r[2], r[1])):
            latest[r[0]] = r
        for path, size, mtime, removed, text in latest.values():
            was = state.get(path)
            if removed and was:
                del state[path]
                reports.append((number, "removed", path))
            elif not removed and (was is None or was[:2] != (size, mtime)):
                state[path] = (size, mtime, text)
                reports.append((number, "updated" if was else "added", path))
        for _ in range(2):
            index.apply(spark.createDataFrame(rows, change), number)
            assert sorted(r.path for r in index.live("entries").collect()) == sorted(state)
            want = Counter((p, w) for p, (_, _, t) in state.items() for w in set(re.findall(r"\w+", t or "")))
            assert Counter((r.path, r.token) for r in index.live("postings").collect()) == want
    assert sorted(map(tuple, index.events().collect())) == sorted(reports)
    assert index.generation() > 0


# --- ignore files and reports


def test_ignore_rules(spark):
    from loomsift.operators import ignores

    files = [
        ("", "*.log\n!keep.log\n/top.txt\nbuild/\ndocs/*.md\n**/cache\na/**/z\nsub/**\n\\!bang\nsp\\ \ntrail   \n[ab]?.c\n[!x]y\nx**y\n"),
        ("a/b", "!*.log\nonly.txt\n"),
    ]
    rules = ignores.ignore_rules(spark.createDataFrame(files, "folder string, text string"))
    # As the format's documentation has them.
    cases = {
        "x.log": True, "d/x.log": True, "keep.log": False, "d/keep.log": False, "top.txt": True, "d/top.txt": False, "build/x": True, "d/build/x": True, "build": False, "docs/a.md": True, "docs/d/a.md": False, "d/docs/a.md": False,
        "cache": True, "d/e/cache": True, "a/z": True, "a/b/z": True, "a/b/c/z": True, "sub/x": True, "sub": False, "!bang": True, "bang": False, "sp ": True, "trail": True, "a1.c": True, "d/b2.c": True, "c1.c": False, "ay": True, "xy": True, "xqy": True, "xq/y": False,
        "a/b/x.log": False, "a/b/c/x.log": False, "a/x.log": True, "a/b/only.txt": True, "a/b/c/only.txt": True, "only.txt": False, "build/keep.log": True,
    }
    got = {r.path: r.ignored for r in ignores.ignored_paths(spark.createDataFrame([(p,) for p in cases], "path string"), rules).collect()}
    assert got == cases


def test_failed_report_leaves_nothing(spark, tmp_path):
    from loomsift.operators import reports

    good = spark.range(20).repartition(4).withColumn("t", F.concat(F.lit("x"), "id"))
    path = tmp_path / "out"
    with pytest.raises(Exception, match="(?i)abort|fail|raise"):
        reports.write_report(good.withColumn("t", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("t"))), str(path), "json")
    assert not path.exists() or not list(path.rglob("*.*"))
    reports.write_report(good, str(path), "json")
    assert not list(path.glob("_*")) and sorted(r.t for r in spark.read.json(str(path)).collect()) == sorted(f"x{i}" for i in range(20))


# --- vectors


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_topk(spark, monkeypatch, block):
    """Against scores one by one: ties by id, copies, null vectors, another length, more queries than a block holds."""
    monkeypatch.setattr(vectors, "MOST_QUERIES", block)
    monkeypatch.setattr(vectors, "CELLS", 500)
    rng = np.random.default_rng(3)
    held = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(700)] + [(700 + i, [3.0] * 6) for i in range(90)]
    odd = [(800, None), (801, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (802, [9.0] * 3), (810, None), (820, [float("nan")] + [0.0] * 5)]
    rows = spark.createDataFrame([*held, *odd], "vec_id long, v array<float>")
    score = lambda a, b: None if a is None or b is None or len(a) != len(b) or None in a + b else float(np.dot(a, b))
    order = lambda s: (1, 0) if s is None else (0, -math.inf if math.isnan(s) else -round(s, 5))
    want = set()
    every = [*held, *odd]
    for i, q in every:
        if i % 20 == 0:
            best = sorted((order(score(q, v)), j) for j, v in every)[:5]
            want |= {(i, j, n + 1, s) for n, (s, j) in enumerate(best)}
    got = vectors.dense_topk(rows, rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v AS q"), 5).collect()
    assert {(r.query_id, r.vec_id, r["rank"], order(r.score)) for r in got} == want and len(got) == len(want)


def test_dense_topk_makes_no_pairs(spark):
    """A row per query and vector was made before the best were kept."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, v array<double>")
    plan = vectors.dense_topk(rows, rows.selectExpr("vec_id AS query_id", "v AS q"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_cache_keys_share_a_state(spark):
    """A state, and a call to the worker, per key and micro-batch took all the time; entries end with event time."""
    rows = spark.createDataFrame([(i % 300, f"t{i % 3}", i, float(i * 5 + 5)) for i in range(1500)] + [(1, "t1", 2000, 90_000.0), (4, "t1", 2001, 200_000.0), (4, "t1", 2002, 200_060.0)], "user long, kind string, event_id long, at double")
    rows = rows.select("user", "kind", "event_id", F.timestamp_seconds("at").alias("ts"), F.lit(60).alias("ttl"), (F.col("event_id") >= 2000).cast("int").alias("part"))
    live = stateful.drained(stateful.replayed(rows, "c", 2, F.col("part")), lambda s: stateful.cache_hits(s, "user", "kind"), "c-hits")
    assert sorted(live.collect()) == sorted(stateful.cache_hits_batch(rows, "user", "kind").collect())
    state = spark.read.format("statestore").option("stateVarName", "held").load(live.inputFiles()[0].rpartition("/rows/")[0] + "/state")
    assert state.count() <= 2  # of 300 keys those that haven't ended


# --- memory of searches


def test_worker_batches_are_bounded(spark):
    """Rows that a worker gets at a time: a batch of 10,000 texts or blocks took the memory of an executor."""
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    before = spark.conf.get(formats.ARROW_ROWS)
    got = formats.stored(spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long"), "sizes", 64)
    assert max(r.n for r in got.collect()) <= 64 and spark.conf.get(formats.ARROW_ROWS) == before
    with pytest.raises(ZeroDivisionError), formats.arrow_rows(spark, 3):
        assert spark.conf.get(formats.ARROW_ROWS) == "3"
        1 / 0
    assert spark.conf.get(formats.ARROW_ROWS) == before


def test_searches_go_by_few_rows_at_a_time(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(formats, "arrow_rows", lambda s, most, f=formats.arrow_rows: (seen.append(most), f(s, most))[1])
    monkeypatch.setattr(blockmax, "arrow_rows", formats.arrow_rows)
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b3")], "item_id long, text string")
    assert [r.doc_id for r in retrieval.lexical_topk(docs, asked, 1).collect()] == [3] and seen == [blockmax.TEXTS, blockmax.AHEAD, blockmax.AHEAD]
    seen.clear()
    assert [r.doc_id for r in vectors.vector_topk(docs, asked, 1, 0.0).collect()] == [3] and blockmax.TEXTS in seen


def test_scores_are_added_in_parts(monkeypatch):
    """Many queries with common tokens: as many at a time as there is room for, with the same result."""
    rng = np.random.default_rng(5)
    held = [[int(d) for d in np.flatnonzero(rng.random(40) < 0.6)] for _ in range(9)]
    blocks = pa.RecordBatch.from_pydict({"docs": pa.array([list(range(40))], pa.list_(pa.int64())), "tokens": [[f"t{i}" for i in range(9)]], "counts": pa.array([[len(h) for h in held]], pa.list_(pa.int32())), "held": pa.array([np.concatenate(held).astype("<u2").tobytes()], pa.binary())})
    pairs = [(q, t) for q in range(70) for t in range(9) if rng.random() < 0.4]
    batch = blockmax.Batch(pa.table({"item_id": [q for q, _ in pairs], "token": [f"t{t}" for _, t in pairs], "terms": [3] * len(pairs), "w": [1.0 + t / 7 for _, t in pairs]}))
    out, asked = [], []
    count = np.bincount
    monkeypatch.setattr(blockmax.np, "bincount", lambda *a: (asked.append(len(a[0])), count(*a))[1])
    for cells in (1 << 20, 300):
        monkeypatch.setattr(blockmax, "CELLS", cells)
        best = blockmax.Best(len(batch.items), 4)
        asked.clear()
        blockmax._search(blocks, batch, best)
        out.append((best.rows.tolist(), max(asked)))
    assert out[0][0] == out[1][0] and len(out[0][0]) == 4 * len(batch.items) and out[1][1] <= 700 < out[0][1]
