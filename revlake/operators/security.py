"""Security issues and tool reports as tables, and the scan gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlake.functions import reports as R
from revlake.functions.rules import SOURCE_RULES, Rule, rule_issues
from revlake.operators.complexity import rank_of

ALL_TOOLS = tuple(dict.fromkeys((*R.SECURITY_TOOLS, *R.COMPLEXITY_TOOLS)))
ISSUE_FIELDS = ("test_id", "description", "severity", "confidence", "line_number")


def security_issues(scan_reports: DataFrame, tool: str | None = None) -> DataFrame:
    """One row per issue in scanner reports, for all tools or one."""
    rows = scan_reports if tool is None else scan_reports.filter(F.col("tool") == tool)
    issues = R.by_tool(F.col("tool"), F.col("stdout"), R.SECURITY_TOOLS, R.ISSUE_TYPE)
    return rows.select("function_id", "tool", F.inline(issues))


def issues_by_language(scan_reports: DataFrame, language: str) -> DataFrame:
    """Issues of one language's scanner; an unknown language gives no rows."""
    tool = R.SECURITY_TOOL_OF.get(language)
    if tool is None:
        return security_issues(scan_reports).limit(0)
    return security_issues(scan_reports, tool)


def bandit_scan(scan_reports: DataFrame) -> DataFrame:
    return issues_by_language(scan_reports, "python")


def complexity_reports(scan_reports: DataFrame, threshold: Column | int) -> DataFrame:
    """One row per function named in a complexity tool's report."""
    results = R.by_tool(F.col("tool"), F.col("stdout"), R.COMPLEXITY_TOOLS, R.RESULT_TYPE)
    rows = scan_reports.select("*", F.inline(results))
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold
    return rows.select(
        "function_id", "tool", "result_name", "score",
        rank_of(F.col("score")).alias("rank"), (F.col("score") > limit).alias("is_flagged"),
    )


def report_health(scan_reports: DataFrame) -> DataFrame:
    """Reports per tool and how many of them could not be read."""
    unread = ~R.is_readable(F.col("tool"), F.col("stdout"))
    return scan_reports.groupBy("tool").agg(
        F.count("*").alias("reports"), F.count_if(unread).alias("unreadable")
    )


def observed(scan_reports: DataFrame, observation: Observation) -> DataFrame:
    """The reports; while a job reads them, each tool's reports and unreadable ones are counted."""
    unread = ~R.is_readable(F.col("tool"), F.col("stdout"))
    counts = []
    for tool in ALL_TOOLS:
        own = F.coalesce(F.col("tool") == tool, F.lit(False))
        counts += [F.count_if(own).alias(tool), F.count_if(own & unread).alias(f"{tool}_unreadable")]
    return scan_reports.observe(observation, *counts)


def observed_health(spark: SparkSession, observation: Observation) -> DataFrame:
    """``report_health`` of the reports that a finished job has read; tools without a report are left out."""
    found = observation.get
    rows = [(tool, found[tool], found[f"{tool}_unreadable"]) for tool in ALL_TOOLS if found[tool]]
    return spark.createDataFrame(rows, "tool string, reports long, unreadable long")


def scan_functions(functions: DataFrame, rules: tuple[Rule, ...] = SOURCE_RULES) -> DataFrame:
    """Issues found by source rules in function texts; ``issues`` stays in the row."""
    return functions.withColumn(
        "issues", rule_issues(F.col("source_code"), F.col("language"), rules)
    )


def scan_texts(texts: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule match and line of any text column."""
    return texts.select(key, F.inline(rule_issues(F.col(text), None, rules)))


# Lengths of the runs by which texts meet rules. A rule takes the longest that
# its needle holds, so that few needles share it however many rules there are.
ANCHOR_LENGTHS = (3, 5, 8)

# Bits of the filter of anchors by which texts leave out most of their runs: so many
# for each anchor, in blocks of so many words, and the most blocks of 8 kB that are sent.
ANCHOR_BITS, BLOCK_WORDS, MOST_BLOCKS = 32, 1024, 16_384
_WORD_BITS, _PROBES = 64, 3

# Stands behind a text's end, so that every character begins a run of the greatest length.
_PAD = "\x00" * (max(ANCHOR_LENGTHS) - 1)


def _grams(text: Column, length: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules with an ``anchor``: of a needle's runs of the longest anchor length the one that fewest needles have.

    Rules are rows of rule_id, language (null: all), needle (three characters or
    more that every match's text holds), pattern, severity, confidence and
    description.
    """
    needle, of_longest = F.col("needle"), None
    for length in reversed(ANCHOR_LENGTHS):
        long_enough, runs = F.length(needle) >= length, _grams(needle, length)
        of_longest = F.when(long_enough, runs) if of_longest is None else of_longest.when(long_enough, runs)
    grams = rules.select("rule_id", F.explode(of_longest).alias("gram"))
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    anchors = counted.groupBy("rule_id").agg(F.min(F.struct("n", "gram"))["gram"].alias("anchor"))
    return rules.join(anchors, "rule_id")


def _places(hashed: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a hash, and the numbers of its bits there, each from bits of its own."""
    block = F.pmod(F.shiftrightunsigned(hashed, 48), F.lit(blocks)).cast("int")
    last = F.lit(BLOCK_WORDS * _WORD_BITS - 1)
    return block, [F.shiftrightunsigned(hashed, 16 * i).bitwiseAND(last).cast("int") for i in range(_PROBES)]


def _word_and_bit(place: Column) -> tuple[Column, Column]:
    return F.shiftright(place, 6), place.bitwiseAND(F.lit(_WORD_BITS - 1))


def _anchor_filter(anchors: DataFrame, blocks: int) -> DataFrame:
    """Blocks of bits, as arrays of words, in which the bits of each anchor's hash are set."""
    block, places = _places(F.col("_anchor"), blocks)
    word, bit = _word_and_bit(F.col("_place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = anchors.select(block.alias("_block"), F.explode(F.array(*places)).alias("_place")).select("_block", word.alias("_word"), one.alias("_set"))
    number = F.col("id")
    zeros = anchors.sparkSession.range(blocks * BLOCK_WORDS).select(
        F.floor(number / BLOCK_WORDS).cast("int").alias("_block"), (number % BLOCK_WORDS).cast("int").alias("_word"), F.lit(0).cast("long").alias("_set")
    )
    words = bits.unionByName(zeros).groupBy("_block", "_word").agg(F.bit_or("_set").alias("_set"))
    listed = F.array_sort(F.collect_list(F.struct("_word", "_set")))
    return words.groupBy("_block").agg(listed["_set"].alias("_words"))


def _known_anchors(grams: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows whose ``_anchor`` some rule has, and of the others few as long as the filter is below its bound."""
    wanted = -(-anchors.count() * ANCHOR_BITS // (BLOCK_WORDS * _WORD_BITS))
    blocks = max(1, min(MOST_BLOCKS, wanted))
    block, places = _places(F.col("_anchor"), blocks)
    is_set = F.lit(True)
    for word, bit in map(_word_and_bit, places):
        is_set = is_set & (F.getbit(F.get("_words", word), bit) == 1)
    sent = F.broadcast(_anchor_filter(anchors, blocks))
    return grams.withColumn("_block", block).join(sent, "_block").filter(is_set).select(*grams.columns)


def scan_with_rule_table(texts: DataFrame, key: str, text: str, language: str, index: DataFrame) -> DataFrame:
    """One row per match of a table's rules and line; costs follow the rules whose needle a text holds.

    A text meets rules by its own runs of characters, of which only hashes move,
    and those only that a filter of all anchors lets pass, which is sent to every
    task and bounded in size. Only where the needle stands in the text too the
    pattern is tried, line by line, so that hashes need not be unique. ``texts``
    is read twice and ``index`` several times; a caller stages what is dear to
    derive. Null texts and those of fewer characters match nothing.
    """
    named = texts.select(key, text, language, F.xxhash64(key, text, language).alias("_text"))
    grams = named.select("_text", F.explode(_grams(F.concat(text, F.lit(_PAD)), max(ANCHOR_LENGTHS))).alias("_run"))
    # Shorter runs begin the longest one at their place; the padding only adds hashes that no needle confirms.
    hashes = F.array(*[F.xxhash64(F.substring("_run", 1, length)) for length in ANCHOR_LENGTHS])
    grams = grams.select("_text", F.explode(hashes).alias("_anchor"))
    anchors = index.select(F.xxhash64("anchor").alias("_anchor"), "rule_id")
    met = _known_anchors(grams, anchors).join(anchors, "_anchor").select("_text", "rule_id").distinct()
    rule = F.struct("rule_id", "pattern", "severity", "confidence", "description", "needle", F.col("language").alias("of"))
    found = met.join(index.select("rule_id", rule.alias("_rule")), "rule_id").drop("rule_id").join(named, "_text")
    r = F.col("_rule")
    meant = F.contains(F.col(text), r["needle"]) & (r["of"].isNull() | (r["of"] == F.col(language)))
    hits = F.filter(
        F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.regexp_like(line, r["pattern"]), i + 1)), lambda n: n.isNotNull()
    )
    return found.filter(meant).select(
        key, r["rule_id"].alias("test_id"), r["description"].alias("description"), r["severity"].alias("severity"),
        r["confidence"].alias("confidence"), F.explode(hits).alias("line_number"),
    )


def issue_text(test_id: Column, description: Column, severity: Column) -> Column:
    return F.format_string("[%s] %s (severity: %s)", test_id, description, severity)


def gate_issues(issues: DataFrame, flagged: DataFrame) -> DataFrame:
    """Keep issues of functions with a flagged result in repositories that scan.

    ``flagged`` holds function_id and bandit_enabled, one row per flagged result.
    """
    scanned = flagged.filter(F.col("bandit_enabled")).select("function_id")
    return issues.join(scanned, "function_id", "left_semi")


def issue_lists(issues: DataFrame) -> DataFrame:
    """Issue texts of each function as one ordered list."""
    text = issue_text(F.col("test_id"), F.col("description"), F.col("severity"))
    listed = issues.select(
        "function_id", F.struct(F.col("line_number"), F.col("test_id"), text.alias("text")).alias("i")
    )
    return listed.groupBy("function_id").agg(
        F.transform(F.array_sort(F.collect_list("i")), lambda i: i["text"]).alias("security_issues")
    )
