"""Rules over prompts and drafts against findings worked by hand."""

from pyspark.sql import functions as F

from loomsift.operators.drafts import effect_findings

COUNT = ["file-count request needs a count-producing command such as wc -l", "file-count request must count regular files, not directories or all entries"]
CASES = [
    ("copy files recursively into a new folder on the Desktop", "mkdir -p ~/Desktop/new && cp -r . ~/Desktop/new", []),
    ("copy files recursively into a new folder on the Desktop", "cp -r . $HOME/Documents", ["compound request creates a destination folder but draft has no mkdir step", "draft does not mention the requested standard home folder"]),
    ("how many files are here", "ls -la", COUNT),
    ("how many files are here", "find . -type f | wc -l", []),
    ("how many files are here", "ls | grep -v '/$' | wc -l", []),
    ("show images", "find . -name '*.png'", ["image-file request must restrict results to regular files"]),
    ("search for TODO in text, case insensitive", "rg todo", ["case-insensitive text search needs an ignore-case flag"]),
    ("search for TODO in text, case insensitive", "grep -Rni todo .", []),
    ("list files here", "ls | grep x", ["plain listing request should not add filtering, recursion, or transformation"]),
    ("show the 3 largest files", "ls -lS | head -n 3", ["largest-file request needs size sorting or filtering and should limit results when a count is requested"]),
    ("show the 3 largest files", "find . -type f -size +1M | head -n 3", []),
    ("list only directories", "ls -d */", []),
    ("list only directories", "ls", ["directories-only request must select directories rather than all entries"]),
    ("move files under x into a folder named old", "mkdir old; find . -type f | xargs mv -t old", ["destination creation should be chained before the transfer with &&", "find-to-xargs transfer should be null-delimited or use -exec"]),
    (None, None, []),
]


def test_findings(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(CASES)], "i int, p string, c string")
    got = {r.i: r.f for r in df.select("i", effect_findings(F.col("p"), F.col("c")).alias("f")).collect()}
    for i, (prompt, command, want) in enumerate(CASES):
        assert got[i] == want, (prompt, command)


def test_no_rows(spark):
    df = spark.createDataFrame([], "p string, c string")
    assert df.select(effect_findings(F.col("p"), F.col("c"))).collect() == []
