"""Tool calls in what a model says: tagged, as JSON that may need repair, or broken off; and chat streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..registry import query
from ..sources.model_output import CHAT_SQL, SAID_SQL, chat_lines, said


# Tags around a call, and what stands for a quote inside.
TAGS = [("<|tool_call>", "<tool_call|>"), ("<tool_call>", "</tool_call>"), ("<|tool_call|>", "<|/tool_call|>")]
QUOTES = ['<|\\"|>', '<|"|>']
#: Where a command that is not closed ends.
CUTS = r"(?s)^(.*?)(?:,|\n|\}|<tool_call|<\|/tool_call\|>|\z)"
SHELL = "call:execute_shell_command"
BRACES = r"[{}]"
BLOCK = r"(?s)^call:([^{]*)\{(.*)\}\s*\z"
KEY = r"([A-Za-z_][A-Za-z0-9_]*)\s*:"
#: The same keys: a word is tried once, from its start, as a later start in it would end no otherwise.
KEY_ONCE = r"(?<![A-Za-z0-9_])([0-9]*+)([A-Za-z_][A-Za-z0-9_]*+)\s*+:"
FENCED = r"(?s)```(?:json\s*)?(.*?)```"
EDGES = r"(?s)^\s+|\s+\z"
WHITE = " \t\n\x0b\f\r"


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in "|<>/" else c for c in text).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")


#: Everything that a scan for tagged calls stops at.
MARKS = "|".join([*(_escaped(t) for pair in TAGS for t in pair), BRACES])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def marks(text: Column, pattern: str) -> Column:
    """array<struct<gap, mark, next>>: what the pattern finds, with the code points before each and the text up to the
    next one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    after = lambda g: F.slice(g, 2, F.size(g))
    pairs = let(gaps, lambda g: F.zip_with(g, F.concat(after(g), F.array(F.lit(None).cast("string"))), lambda x, y: F.struct(F.char_length(x).alias("gap"), y.alias("next"))))
    return F.zip_with(pairs, found, lambda p, m: F.struct(p["gap"].alias("gap"), m.alias("mark"), p["next"].alias("next")))


def first_object(text: Column) -> Column:
    """The first opening brace with all up to the brace that closes it; null if none does.

    One pass over the braces that carries their depth, so nesting and length are not limited."""

    def step(s: Column, x: Column) -> Column:
        at, opens, closes = s["at"] + x["gap"], x["mark"] == "{", (x["mark"] == "}") & (s["depth"] > 0)
        depth = F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        start = F.when((s["start"] < 0) & opens, at).otherwise(s["start"])
        end = F.when((s["end"] < 0) & closes & (depth == 0), at + 1).otherwise(s["end"])
        return F.struct((at + 1).alias("at"), depth.alias("depth"), start.alias("start"), end.alias("end"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(marks(text, BRACES), begin, step, lambda s: F.when(s["end"] >= 0, F.substr(text, s["start"] + 1, s["end"] - s["start"])))


OUTSIDE, TO_TAG, TO_BRACE, STOPPED = range(4)


def tagged_blocks(text: Column) -> Column:
    """array<string>: what stands between tags, in order; where an end tag is missing, the call up to the brace that
    closes it, and nothing from a tag on whose call isn't closed either.

    One pass over tags and braces: inside a block that has an end tag nothing else counts, in one that has none the
    braces do."""
    last = [F.when(F.contains(text, F.lit(b)), F.char_length(text) - F.char_length(F.substring_index(text, b, -1)) - len(b)).otherwise(-1) for _, b in TAGS]

    def step(s: Column, x: Column, ends: Column) -> Column:
        m, at = x["mark"], s["at"] + x["gap"]
        after = at + F.char_length(m)
        kind = F.coalesce(*[F.when(m == a, F.lit(i)) for i, (a, _) in enumerate(TAGS)], F.lit(-1))
        begins = (s["mode"] == OUTSIDE) & (kind >= 0)
        closed = (s["mode"] == TO_TAG) & F.coalesce(*[F.when(m == b, s["kind"] == i) for i, (_, b) in enumerate(TAGS)], F.lit(False))
        in_call = s["mode"] == TO_BRACE
        depth = F.when(in_call & (m == "{"), s["depth"] + 1).when(in_call & (m == "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(F.when(in_call, s["depth"]).otherwise(0))
        balanced = in_call & (m == "}") & (s["depth"] == 1)
        opened = F.when(F.get(ends, kind) >= after, TO_TAG).when(F.regexp_like(x["next"], F.lit(r"^\s*+call:")), TO_BRACE).otherwise(STOPPED)
        mode = F.when(begins, opened).when(closed | balanced, OUTSIDE).otherwise(s["mode"])
        block = F.struct(s["from"].alias("from"), F.when(closed, at).otherwise(after).alias("to"), closed.alias("closed"))
        now = F.struct(
            after.alias("at"),
            mode.alias("mode"),
            F.when(begins, kind).otherwise(s["kind"]).alias("kind"),
            F.when(begins, after).otherwise(s["from"]).alias("from"),
            depth.alias("depth"),
            F.when(closed | balanced, F.array_append(s["blocks"], block)).otherwise(s["blocks"]).alias("blocks"),
        )
        return F.when(m.isNull(), s).otherwise(now)

    zero = lambda name: F.lit(0).alias(name)
    begin = F.struct(zero("at"), zero("mode"), zero("kind"), zero("from"), zero("depth"), F.array().cast("array<struct<from:int,to:int,closed:boolean>>").alias("blocks"))
    found = let(F.array(*last), lambda ends: F.aggregate(marks(text, MARKS), begin, lambda s, x: step(s, x, ends), lambda s: s["blocks"]))

    def said(block: Column) -> Column:
        inside = F.substr(text, block["from"] + 1, block["to"] - block["from"])
        return F.when(block["closed"], inside).otherwise(F.ltrim(inside, F.lit(WHITE)))

    tagged = F.lit(False)
    for a, _ in TAGS:
        tagged = tagged | F.contains(text, F.lit(a))
    return F.when(tagged, F.transform(found, said)).otherwise(F.array().cast("array<string>"))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repaired(c: Column) -> Column:
    """Braces around, double quotes for single ones, and booleans in lower case."""
    text = strip(c)
    text = F.when(text.startswith("{"), text).otherwise(F.concat(F.lit("{"), text, F.lit("}")))
    for own, right in (("'", '"'), (": True", ": true"), (": False", ": false")):
        text = F.replace(text, F.lit(own), F.lit(right))
    return text


def first_json(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(is_json(c), c) for c in candidates])


def argument(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def keys(json: Column) -> Column:
    return F.array_join(F.sort_array(F.json_object_keys(json)), ",")


def tagged_calls(df: DataFrame, text: str = "said") -> DataFrame:
    """``df`` with call_no, name, arguments (JSON): a row per call between tags that can be read."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    rows = df.withColumn("_plain", plain).select("*", F.posexplode(tagged_blocks(F.col("_plain"))).alias("call_no", "_b"))
    rows = rows.withColumn("name", strip(F.regexp_extract("_b", BLOCK, 1)))
    body = F.regexp_extract("_b", BLOCK, 2)
    for mark in QUOTES:
        body = F.replace(body, F.lit(mark), F.lit('"'))
    quoted = F.concat(F.lit("{"), F.regexp_replace(strip(F.replace(body, F.lit("\n"), F.lit(" "))), KEY_ONCE, '$1"$2":'), F.lit("}"))
    rows = rows.withColumn("arguments", let(quoted, lambda q: first_json(q, repaired(q))))
    return rows.where((F.col("name") != "") & F.col("arguments").isNotNull()).drop("_plain", "_b")


def json_candidate(text: Column) -> Column:
    """The whole text if braces enclose it, else a fenced object, else the first object in it, else the text."""
    whole, fenced = strip(text), strip(F.regexp_extract(text, FENCED, 1))
    enclosed = lambda c: c.startswith("{") & c.endswith("}")
    return F.when(enclosed(whole), whole).when(enclosed(fenced), fenced).otherwise(F.coalesce(first_object(whole), whole))


def json_call(text: Column) -> Column:
    """The JSON object of a call, repaired if need be; null if there is none or it has no name."""
    found = let(json_candidate(text), lambda c: first_json(c, repaired(c), repaired(text)))
    return let(found, lambda j: F.when(F.coalesce(argument(j, "$.tool"), argument(j, "$.name")).isNotNull(), j))


def partial_command(text: Column) -> Column:
    """The command of a shell call that is broken off; null if there is none."""
    after = F.regexp_extract(text, rf"(?s){SHELL}.*?cmd:(.*)\z", 1)

    def of(mark: str) -> Column:
        rest = F.substring(after, F.instr(after, mark) + len(mark), F.char_length(after))
        closed = F.instr(rest, mark) > 0
        inside = F.when(closed, F.substring_index(rest, mark, 1)).otherwise(F.regexp_extract(rest, CUTS, 1))
        return F.when(F.instr(after, mark) > 0, F.nullif(strip(inside), F.lit("")))

    return F.coalesce(*[of(m) for m in QUOTES[::-1]])



def balanced(depth: int) -> str:
    """Braces with braces inside, ``depth`` levels deep: for SQL, whose inputs nest no deeper where it is used."""
    return r"\{(?:[^{}]|" + balanced(depth - 1) + r")*\}" if depth > 1 else r"\{[^{}]*\}"


_CALL = r"call:[^{]*" + balanced(6)
_TAGGED = "(?s)" + "|".join(rf"{_escaped(a)}(?:.*?{_escaped(b)}|\s*{_CALL})" for a, b in TAGS)
_STRIP = "(?s)^(?:" + "|".join(_escaped(a) for a, _ in TAGS) + r")\s*|(?:" + "|".join(_escaped(b) for _, b in TAGS) + r")\z"
_q = lambda p: p.replace("'", "''")
_strip_sql = lambda x: f"regexp_replace({x}, '{EDGES}', '', 'g')"


def _repaired_sql(x: str) -> str:
    text = _strip_sql(x)
    text = f"CASE WHEN starts_with({text}, '{{') THEN {text} ELSE '{{' || {text} || '}}' END"
    return f"replace(replace(replace({text}, '''', '\"'), ': True', ': true'), ': False', ': false')"


_keys_sql = lambda x: f"array_to_string(list_sort(json_keys({x})), ',')"


@query(
    f"WITH {SAID_SQL}, m AS (SELECT conv_id, turn, unnest(regexp_extract_all(said, '{_q(_TAGGED)}')) AS m, generate_subscripts(regexp_extract_all(said, '{_q(_TAGGED)}'), 1) - 1 AS call_no FROM said), "
    f"b AS (SELECT conv_id, turn, call_no, regexp_replace(m, '{_q(_STRIP)}', '', 'g') AS b FROM m), "
    f"a AS (SELECT conv_id, turn, call_no, trim(regexp_extract(b, '{BLOCK}', 1)) AS name, '{{' || regexp_replace(trim(replace(replace(replace(regexp_extract(b, '{BLOCK}', 2), '{QUOTES[0]}', '\"'), '{QUOTES[1]}', '\"'), chr(10), ' ')), '{KEY}', '\"\\1\":', 'g') || '}}' AS j FROM b), "
    f"r AS (SELECT *, {_repaired_sql('j')} AS fixed FROM a), g AS (SELECT *, CASE WHEN json_valid(j) THEN j WHEN json_valid(fixed) THEN fixed END AS arguments FROM r) "
    f"SELECT conv_id, turn, call_no, name, json_extract_string(arguments, '$.cmd') AS cmd, {_keys_sql('arguments')} AS keys FROM g WHERE name <> '' AND arguments IS NOT NULL"
)
def m1_tagged_calls(spark, sf_dir):
    """Calls between tags, closed or not (M1)."""
    rows = tagged_calls(said(spark, sf_dir))
    return rows.select("conv_id", "turn", F.col("call_no").cast("long").alias("call_no"), "name", argument(F.col("arguments"), "$.cmd").alias("cmd"), keys(F.col("arguments")).alias("keys"))


@query(
    f"WITH {SAID_SQL}, c AS (SELECT conv_id, turn, said, {_strip_sql('said')} AS whole, {_strip_sql(f'regexp_extract(said, $${FENCED}$$, 1)')} AS fenced FROM said), "
    "g AS (SELECT conv_id, turn, unnest(regexp_extract_all(whole, '[{}]')) AS mark, unnest(list_transform(regexp_split_to_array(whole, '[{}]'), lambda x: len(x))) AS gap, unnest(range(1, 2 + len(regexp_extract_all(whole, '[{}]')))) AS n FROM c), "
    "p AS (SELECT *, sum(gap + 1) OVER (PARTITION BY conv_id, turn ORDER BY n) AS place, min(CASE WHEN mark = '{' THEN n END) OVER (PARTITION BY conv_id, turn) AS first FROM g WHERE mark IS NOT NULL), "
    "d AS (SELECT *, sum(CASE WHEN mark = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS depth FROM p WHERE n >= first), "
    "o AS (SELECT conv_id, turn, CAST(min(place) AS BIGINT) AS lo, CAST(min(CASE WHEN depth = 0 THEN place END) AS BIGINT) AS hi FROM d GROUP BY ALL), "
    "k AS (SELECT c.*, CASE WHEN starts_with(whole, '{') AND ends_with(whole, '}') THEN whole WHEN starts_with(fenced, '{') AND ends_with(fenced, '}') THEN fenced WHEN hi IS NOT NULL THEN substr(whole, lo, hi - lo + 1) ELSE whole END AS cand FROM c LEFT JOIN o USING (conv_id, turn)), "
    f"f AS (SELECT *, {_repaired_sql('cand')} AS one, {_repaired_sql('said')} AS two FROM k), j AS (SELECT conv_id, turn, CASE WHEN json_valid(cand) THEN cand WHEN json_valid(one) THEN one WHEN json_valid(two) THEN two END AS j FROM f) "
    f"SELECT conv_id, turn, coalesce(json_extract_string(j, '$.tool'), json_extract_string(j, '$.name')) AS name, coalesce(json_extract_string(j, '$.arguments.cmd'), json_extract_string(j, '$.args.cmd')) AS cmd, "
    "coalesce(array_to_string(list_sort(json_keys(j, CASE WHEN json_extract(j, '$.arguments') IS NULL THEN '$.args' ELSE '$.arguments' END)), ','), '') AS keys FROM j WHERE coalesce(json_extract_string(j, '$.tool'), json_extract_string(j, '$.name')) IS NOT NULL"
)
def m2_json_calls(spark, sf_dir):
    """Calls as JSON: found in running text or a fence, repaired, with alias names of fields (M2)."""
    rows = said(spark, sf_dir).withColumn("j", json_call(F.col("said"))).where("j is not null")
    name = F.coalesce(argument(F.col("j"), "$.tool"), argument(F.col("j"), "$.name"))
    own = F.coalesce(argument(F.col("j"), "$.arguments"), argument(F.col("j"), "$.args"), F.lit("{}"))
    return rows.select("conv_id", "turn", name.alias("name"), argument(own, "$.cmd").alias("cmd"), keys(own).alias("keys"))


def _partial_sql(mark: str) -> str:
    rest = f"substr(after, instr(after, '{mark}') + {len(mark)})"
    return f"CASE WHEN contains(after, '{mark}') THEN nullif({_strip_sql(f'CASE WHEN contains({rest}, $${mark}$$) THEN split_part({rest}, $${mark}$$, 1) ELSE regexp_extract({rest}, $${CUTS}$$, 1) END')}, '') END"


@query(
    rf"WITH {SAID_SQL}, a AS (SELECT conv_id, turn, regexp_extract(said, '(?s){SHELL}.*?cmd:(.*)\z', 1) AS after FROM said), p AS (SELECT conv_id, turn, coalesce({', '.join(_partial_sql(m) for m in QUOTES[::-1])}) AS cmd FROM a) SELECT * FROM p WHERE cmd IS NOT NULL"
)
def m3_partial_commands(spark, sf_dir):
    """Commands of shell calls that are broken off (M3)."""
    return said(spark, sf_dir).select("conv_id", "turn", partial_command(F.col("said")).alias("cmd")).where("cmd is not null")


CHUNK = "message struct<thinking:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>, done boolean, prompt_eval_count long, eval_count long, error string"


def chat_events(lines: DataFrame) -> DataFrame:
    """stream_id, line_no, event_no, kind, content, name, arguments, prompt_tokens, completion_tokens.

    Each line's thinking, text and calls come in this order, usage where the stream is done; an error, or
    a line that is no JSON, is a stream's last event; blank lines say nothing."""
    rows = lines.where(F.trim("line") != "").withColumn("c", F.from_json("line", CHUNK)).withColumn("wrong", F.when(~is_json(F.col("line")), F.lit("invalid chunk")).otherwise(F.col("c.error")))
    first = F.min(F.when(F.col("wrong").isNotNull(), F.col("line_no"))).over(Window.partitionBy("stream_id"))
    rows = rows.withColumn("end", first).where(F.col("end").isNull() | (F.col("line_no") <= F.col("end")))

    def event(kind: str, content=None, name=None, arguments=None, prompt=None, completion=None) -> Column:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        number = lambda c: (F.lit(None) if c is None else c).cast("long")
        return F.struct(F.lit(kind).alias("kind"), text(content).alias("content"), text(name).alias("name"), text(arguments).alias("arguments"), number(prompt).alias("prompt_tokens"), number(completion).alias("completion_tokens"))

    said_ = [F.when(F.col(f"c.message.{f}") != "", event(kind, F.col(f"c.message.{f}"))) for f, kind in (("thinking", "thinking"), ("content", "text"))]
    calls = F.transform(F.coalesce("c.message.tool_calls", F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")), lambda t: event("tool_call", None, t["function"]["name"], t["function"]["arguments"]))
    usage = F.when(F.col("c.done") & F.col("c.eval_count").isNotNull(), event("usage", prompt=F.coalesce("c.prompt_eval_count", F.lit(0)), completion=F.col("c.eval_count")))
    good = F.concat(F.array_compact(F.array(*said_)), calls, F.array_compact(F.array(usage)))
    events = F.when(F.col("wrong").isNotNull(), F.array(event("error", F.col("wrong")))).otherwise(good)
    return rows.select("stream_id", "line_no", F.posexplode(events).alias("event_no", "e")).select("stream_id", "line_no", F.col("event_no").cast("long").alias("event_no"), "e.*")


_NULLS = "NULL::VARCHAR AS name, NULL::VARCHAR AS arguments, NULL::BIGINT AS prompt_tokens, NULL::BIGINT AS completion_tokens"


@query(
    f"WITH {CHAT_SQL}, w AS (SELECT *, CASE WHEN NOT json_valid(line) THEN 'invalid chunk' ELSE json_extract_string(CASE WHEN json_valid(line) THEN line ELSE '{{}}' END, '$.error') END AS wrong, CASE WHEN json_valid(line) THEN line ELSE '{{}}' END AS j FROM chat_lines WHERE trim(line) <> ''), "
    "e AS (SELECT *, min(CASE WHEN wrong IS NOT NULL THEN line_no END) OVER (PARTITION BY stream_id) AS last FROM w), g AS (SELECT * FROM e WHERE last IS NULL OR line_no <= last), ok AS (SELECT * FROM g WHERE wrong IS NULL), "
    "t AS (SELECT stream_id, line_no, unnest(json_extract(j, '$.message.tool_calls[*]')) AS t, generate_subscripts(json_extract(j, '$.message.tool_calls[*]'), 1) AS k FROM ok), "
    f"a AS (SELECT stream_id, line_no, 0 AS o, 0 AS k, 'error' AS kind, wrong AS content, {_NULLS} FROM g WHERE wrong IS NOT NULL "
    f"UNION ALL SELECT stream_id, line_no, 1, 0, 'thinking', json_extract_string(j, '$.message.thinking'), {_NULLS} FROM ok WHERE json_extract_string(j, '$.message.thinking') <> '' "
    f"UNION ALL SELECT stream_id, line_no, 2, 0, 'text', json_extract_string(j, '$.message.content'), {_NULLS} FROM ok WHERE json_extract_string(j, '$.message.content') <> '' "
    "UNION ALL SELECT stream_id, line_no, 3, k, 'tool_call', NULL, json_extract_string(t, '$.function.name'), CAST(json_extract(t, '$.function.arguments') AS VARCHAR), NULL, NULL FROM t "
    "UNION ALL SELECT stream_id, line_no, 4, 0, 'usage', NULL, NULL, NULL, coalesce(CAST(json_extract(j, '$.prompt_eval_count') AS BIGINT), 0), CAST(json_extract(j, '$.eval_count') AS BIGINT) FROM ok WHERE json_extract_string(j, '$.done') = 'true' AND json_extract(j, '$.eval_count') IS NOT NULL) "
    "SELECT stream_id, line_no, row_number() OVER (PARTITION BY stream_id, line_no ORDER BY o, k) - 1 AS event_no, kind, content, name, arguments, prompt_tokens, completion_tokens FROM a"
)
def m4_chat_events(spark, sf_dir):
    return chat_events(chat_lines(spark, sf_dir))
