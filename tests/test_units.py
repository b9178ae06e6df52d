"""Small cases of single operators, streams and index files."""

import pytest
from pyspark.sql import functions as F

from loomsift.functions import halves, hashing, text
from loomsift.operators import addresses, chunking, intents, planning, scanner, search, shell, store, tables_and_code, toolcalls, vectors, web
from loomsift.sources import formats
from loomsift.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_fnv(spark):
    def brute(s):
        h = hashing.BASIS
        for b in s.encode():
            h = (h ^ b) * ((1 << 40) + hashing.LOW_PRIME) % (1 << 64)
        return h

    for s in ("", "a", "foobar", "é日"):
        r = one(spark, s, hashing.fnv1a_limbs(F.col("v")))
        assert (r.hi << 32) + r.lo == brute(s)


def test_text(spark):
    assert one(spark, "Ab-c_d É!x", text.tokens("v")) == ["ab-c_d", "É", "x"]
    assert one(spark, "a&amp;lt;b&nbsp;", text.unescape(F.col("v"))) == "a&lt;b "
    assert one(spark, "x" * 50, text.trim_to_tokens("v", 10)) == "x" * 39 + "…"
    assert one(spark, "aé日", text.cut_bytes("v", 4)) == "aé"
    assert one(spark, "Authorization: Bearer abc\npassword=x", text.redact(F.col("v"))) == "Authorization: Bearer <redacted>\npassword=<redacted>"


@pytest.mark.parametrize("command, hit", [("rm -rf /", 0), ("rm -rf ~/", 1), ("sudo rm -r x", 7), ("ls", None), ("echo x > /etc/y", 10)])
def test_floor(spark, command, hit):
    assert one(spark, command, shell.floor_match(F.col("v"))) == hit


def test_scan(spark):
    lines = ["ls 'a b' | wc -l", "echo 'x", "ls &&", "ls && ", "a $(b)", "a )", "&& ", 'say "a\\"b" c\\ d', "", "a > b; c &", "f(x"]
    got = {r.command: r for r in scanner.scanned(spark.createDataFrame([(x,) for x in lines], "command string")).collect()}
    assert got[lines[0]].words == ["ls", "a b", "wc", "-l"] and got[lines[0]].pipeline and not got[lines[0]].ambiguous
    assert got["echo 'x"].unbalanced_quotes and got["ls &&"].trailing_operator and not got["ls && "].trailing_operator and got["&& "].trailing_operator
    assert got["a $(b)"].substitution and got["a $(b)"].words == ["a", "$(b)"] and got["a )"].unbalanced_group and got["f(x"].warnings == ["unbalanced grouping parentheses"]
    assert got[lines[7]].words == ["say", 'a"b', "c d"] and got[""].ambiguous and got["a > b; c &"].risky and got["a > b; c &"].words == ["a", "b", "c"]


def test_pieces(spark):
    cut = lambda t, n: one(spark, t, chunking.pieces(F.col("v"), n))
    assert cut("a. b. c.", 4) == ["a.", "b.", "c."] and cut("p\n\nq", 100) == ["p\n\nq"] and cut("", 5) == [] and cut("x" * 50 + ". y.", 10) == ["x" * 50 + ".", "y."]


def test_web(spark):
    show = lambda page: one(spark, page, tables_and_code.with_tables_and_code(F.col("v")))
    assert show("x<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>y") == "x\n| a | b |\n| --- | --- |\n| 1 |  |\ny"
    assert show("<pre class='language-sh'>a &lt; b\n\n</pre>") == "\n```bash\na < b\n```\n" and show("<table></table>") == " " and show("z") == "z"
    assert one(spark, "http://h/p?utm_x=1&a=2&fbclid=3#f", web.clean_url(F.col("v"))) == "http://h/p?a=2#f"
    assert search.glob_regex("a*.txt").startswith("^a")


@pytest.mark.parametrize(
    "reason, urls",
    [
        ("address", ["http://127.0.0.1/", "http://10.0.0.1", "http://172.31.0.1/", "http://192.168.1.1:8/", "http://169.254.169.254/", "http://239.1.1.1/", "http://u:p@127.0.0.1/"]),
        ("address", ["http://[::1]/", "http://[0:0:0:0:0:0:0:1]/", "http://[fe80::1]/", "http://[fd00::1]/", "http://[ff02::1]/", "http://[::ffff:127.0.0.1]/", "http://[::ffff:7f00:1]/", "http://[::]/"]),
        ("ok", ["http://8.8.8.8/", "http://172.32.0.1/", "http://[2001:db8::1]/", "http://[::ffff:8.8.8.8]/", "http://[fec0::1]/", "https://a.example/10.0.0.1"]),
        ("local", ["http://localhost/", "http://a.local", "http://x.internal./", "HTTP://LocalHost:80"]),
        ("scheme", ["ftp://a/", "file:///etc/passwd", "javascript:x"]),
        ("host", ["http:///x"]),
    ],
)
def test_url_policy(spark, reason, urls):
    assert {u: one(spark, u, addresses.url_policy(F.col("v"))) for u in urls} == dict.fromkeys(urls, reason)


def test_halves(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), rng.normal(size=100) * 1e-6, [0, 1, -1, 65504, 65519, 1e9, 2**-24, 2**-25, 1 + 2**-11, 0.1, 2047.5, 6.1e-5]])
    rows = spark.createDataFrame([(float(x),) for x in values], "x double").select("x", halves.half_bits(F.col("x")).alias("b")).select("x", "b", halves.from_bits(F.col("b")).alias("y")).collect()
    for r in rows:
        want = np.float64(r.x).astype(np.float16)
        assert r.b == int(want.view(np.uint16)), r
        assert r.y == float(want) or np.isinf(want)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0] * 10), (3, [])], "vec_id long, embedding array<double>")
    got = {r.vec_id: list(r.v) for r in rows.select("vec_id", vectors.fitted(F.col("embedding"), 4).alias("v")).collect()}
    assert got == {1: [0.6, 0.8, 0, 0], 2: [0.5] * 4, 3: [0] * 4}
    with pytest.raises(ValueError):
        vectors.write_vectors(rows, rows.limit(1), 4)


def test_tool_calls(spark):
    rows = [
        "<tool_call>call:a{x: 1}</tool_call> <|tool_call>call:b{y: <|\"|>q<|\"|>}<tool_call|>", "<tool_call>call:c{o: {p: {q: 1}}} and on", "<tool_call>call:{}</tool_call>", "no call",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, said string")
    got = [(r.i, r.call_no, r["name"], r.arguments) for r in toolcalls.tagged_calls(df).orderBy("i", "call_no").collect()]
    assert got == [(0, 0, "a", '{"x": 1}'), (0, 1, "b", '{"y": "q"}'), (1, 0, "c", '{"o": {"p": {"q": 1}}}')]
    parsed = lambda t: one(spark, t, toolcalls.json_call(F.col("v")))
    assert parsed(' {"tool": "x"} ') == '{"tool": "x"}' and parsed("```json\n{\"name\": \"y\"}\n```") == '{"name": "y"}' and parsed("a {'name': 'z', 'b': True, 'c': False} d") == '{"name": "z", "b": true, "c": false}'
    assert parsed("{'name': 'z', 'b': True}") == '{"name": "z", "b": true}' and parsed('{"other": 1}') is None and parsed("") is None
    partial = lambda t: one(spark, t, toolcalls.partial_command(F.col("v")))
    assert partial('call:execute_shell_command{cmd:<|"|>ls -l<|"|>}') == "ls -l" and partial('call:execute_shell_command{cmd:<|"|>ls -l, x') == "ls -l" and partial("call:other{cmd:x}") is None


def test_validation_round(spark):
    rows = [
        (1, "  ", "x", True, "", ["m"]), (2, "zap |", "x", False, "", []), (3, "ls -q /x", "show files sorted by time", True, "usage -a", ["m"]), (4, "ls -t", "sorted files", True, "USAGE -T", ["m"]),
    ]
    df = spark.createDataFrame(rows, "i int, command string, prompt string, command_exists boolean, docs string, grounding array<string>")
    got = {r.i: [f.kind for f in r.findings] for r in planning.validated(df).collect()}
    assert got[1] == ["insufficient_draft"] and got[2][:4] == ["unknown_command", "parse_ambiguous", "parse_ambiguous_risky", "missing_grounding"]
    assert got[3][:2] == ["unsupported_flag", "insufficient_for_prompt"] and "unsupported_flag" not in got[4]


def test_index_errors(spark, tmp_path):
    words = spark.createDataFrame([("a", 2), ("b", 1)], "token string, n_rows long")
    whole = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b")], "doc_id long, token string")
    assert {r.token: r.df for r in store.read_postings(words, whole).collect()} == {"a": 2, "b": 1}
    for broken in (whole.where("token = 'a'"), whole.where("doc_id > 2"), whole.union(spark.createDataFrame([(1, "c")], whole.schema)), whole.where("doc_id <> 2")):
        with pytest.raises(Exception, match="postings"):
            store.read_postings(words, broken).collect()
    with pytest.raises(ValueError, match="inode"):
        store.read_entries(spark.createDataFrame([("/a", 1, 1)], "path string, mtime_secs long, size long"))
    assert formats.read_manifest(spark, str(tmp_path / "none")) is None


def test_lru():
    assert events.lru_hits(list("aabca"), [10] * 5, [0, 1, 2, 3, 4], 2, 100, 10) == [False, True, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    """Windows that the watermark has closed are the batch's."""
    whole = spark.read.parquet(f"{SF}/events.parquet")
    whole.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events.parquet"))
    got = events.run_to_table(events.windowed_counts(events.stream(spark, str(tmp_path), files_per_trigger=4)), "closed", str(tmp_path / "ck"))
    closed = {(r.window.start, r.event_type): r.n for r in got.collect()}
    batch = {(r.window.start, r.event_type): r.n for r in events.windowed_counts(whole.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    last = max(k[0] for k in batch)
    assert closed == {k: v for k, v in batch.items() if k[0] < last}


def test_index_files(spark, tmp_path):
    chunks = spark.range(5).withColumnRenamed("id", "chunk_id")
    formats.write_index({"chunks": chunks}, str(tmp_path), {"index_version": 1})
    version = formats.write_index({"chunks": chunks.where("chunk_id > 1")}, str(tmp_path), {"index_version": 2})
    manifest, tables = formats.read_index(spark, str(tmp_path))
    assert manifest["version"] == version and manifest["index_version"] == "2" and tables["chunks"].count() == 3


def test_page_hints(spark):
    page = "-a, --all  Show all\nand hidden\nOPTIONS\n---\n\t-n\tcount\n-a, --all  again\n-1  no letter\n-x\n" + "\n".join(f"-o{i}  option {i}" for i in range(60))
    rows = spark.createDataFrame([(1, "ls", page), (2, "tool", None), (3, None, ""), (4, "pwd", "text")], "k long, command_name string, raw string")
    found = chunking.option_hints(rows, "k").collect()
    assert [tuple(r)[1:] for r in found][:2] == [(0, "-a, --all", "-a|--all", "Show all and hidden"), (4, "-n", "-n", "count")] and {r.k for r in found} == {1} and len(found) == 48
    docs = {r.k: r.doc for r in intents.augmented(rows).collect()}
    assert docs[2] is None and docs[3] == "" and docs[1].startswith(page + "\n\nUSAGE INTENTS\n") and docs[1].count("\n- `ls -") == 24 + 1 and docs[4].startswith("text\n\nUSAGE INTENTS\n")
    assert "`ls -a, --all`: Show all and hidden Useful for requests about hidden files and all entries, hidden files." in docs[1]


def test_pages_are_augmented_in_their_rows(spark):
    """No page is sorted, grouped or joined by key: windows and sorts of lines took the memory of a task."""
    plan = intents.k12_intent_augmentation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("hashpartitioning", "Window", "Sort", "Aggregate"))
