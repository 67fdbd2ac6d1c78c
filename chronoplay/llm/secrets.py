"""Secret scans with corpus-wide ownership frequency, on DataFrame functions only.

Spans: splitting a text at a pattern gives the gaps between its matches, so
running sums of gap and match lengths give every match's place in code points.
The sums are made in two levels, so many spans of one text aren't quadratic.

Ownership: the hashes of all candidate values are counted over the corpus by
distinct repositories and owners. A value that several owners carry, or that
stands in many repositories of few owners, is a widely copied example; one that
stays with few of both, and whose characters look random, may be live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Fixed patterns: kind, pattern, group that holds the value, its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds that the method adds.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 24),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
)
#: Owners, and repositories, from which on a value is widely copied.
WIDELY, WIDELY_REPOS = 3, 4
#: Share of the entropy that its alphabet allows, which a random value has at least: hex digits, others.
RANDOM_HEX, RANDOM = 0.7, 0.85
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _placed(hits: Column, gaps: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches, from their texts and the lengths of the gaps before them.

    Matches are numbered off in chunks of about the square root of their count:
    places are summed inside each chunk, then the chunks' own lengths.
    """

    def step(acc: Column, hit: Column) -> Column:
        value = F.regexp_extract(hit["hit"], pattern, group) if group else hit["hit"]
        start = acc["at"] + hit["gap"]
        end = start + F.char_length(hit["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(value) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    zero, none = F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>")
    each = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    width = F.ceil(F.sqrt(F.size(hits))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.size(hits), width), lambda i: F.aggregate(F.slice(each, i, width), F.struct(zero, none.alias("out")), step))
    lists = F.aggregate(chunks, F.struct(zero, F.array().cast(f"array<array<{SPAN}>>").alias("out")), shift)
    return F.when(F.size(hits) > 0, F.flatten(lists["out"])).otherwise(none)


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: all spans of the whole text by start, then kind; null counts as empty."""
    text, rows = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs
    kinds = list(enumerate(BASE + MORE))
    # in columns of their own, so that each is computed once
    hits = {f"_hits{i}": F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for i, (_, p, _, _) in kinds}
    rows = rows.withColumns(hits)
    rows = rows.withColumns({f"_gaps{i}": F.when(F.size(f"_hits{i}") > 0, F.transform(F.split(text, p, -1), F.char_length)) for i, (_, p, _, _) in kinds})
    zipped = rows.withColumns({f"_spans{i}": _placed(F.col(f"_hits{i}"), F.col(f"_gaps{i}"), i, p, g, least) for i, (_, p, g, least) in kinds})
    spans = F.array_sort(F.concat(*(F.col(f"_spans{i}") for i, _ in kinds)))
    return zipped.select(*docs.columns, spans.alias("_spans"))


def looks_random(value: Column) -> Column:
    """Whether a value's characters look drawn at random: near its alphabet's entropy, in no sequence, and of mixed kinds or of one."""
    size, chars = F.char_length(value), F.split(value, "")
    share = lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    is_hex = value.rlike("^[0-9a-f]+$")
    alphabet = F.when(value.rlike("^[0-9]+$"), 10).when(is_hex, 16).when(value.rlike("^[A-Z0-9]+$"), 36).when(value.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    enough = entropy >= F.when(is_hex, RANDOM_HEX).otherwise(RANDOM) * F.log2(F.least(size, alphabet))
    after = F.zip_with(F.slice(chars, F.lit(1), size - 1), F.slice(chars, F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = F.size(F.filter(after, lambda x: F.abs(F.ascii(x["b"]) - F.ascii(x["a"])) <= 1))
    kind = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3)
    turns = F.size(F.filter(after, lambda x: kind(x["a"]) != kind(x["b"])))
    mixed = (turns == 0) | (5 * turns >= size - 1)
    return F.when(size >= 8, enough & (2 * near <= size - 1) & mixed).otherwise(F.lit(False))


def _names(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k, *_ in BASE + MORE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """From (_hash, _value, _owner, _repo, ...): each hash with its distinct owners and repositories, and whether its value looks random.

    Rows of a hash are combined by owner and repository before they meet, so a
    value that a third of all documents carry reaches its task as few rows.
    """
    distinct = candidates.groupBy("_hash", "_value", "_owner", "_repo").agg(F.count("*").alias("_rows"))
    counted = distinct.groupBy("_hash", "_value").agg(
        F.count_distinct("_owner").alias("_owners"), F.count_distinct("_repo").alias("_repos"), F.sum("_rows").alias("_rows")
    )
    return counted.withColumn("_random", looks_random(F.col("_value"))).drop("_value")


def secret_scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, widely: int = WIDELY, widely_repos: int = WIDELY_REPOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the counts and places of its secrets.

    ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` are of the base
    kinds; ``spans`` lists all spans as kind:start:end in code points, end
    exclusive. ``n_copied``: spans whose value has at least ``widely`` owners or
    stands in at least ``widely_repos`` repositories; ``n_live``: other spans
    whose value looks random; ``max_owners``, ``max_repos``: those of its most
    copied value (null without spans). Default owner: the column source; default
    repository: source and lang. Null text counts as empty (no spans,
    ``base_sha256`` of the empty string); null owners count as one owner;
    repeated rows are rows of their own and have equal results. An empty table
    gives an empty result. A text's time is in proportion to its length and to
    the power 1.5 of its spans.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("_repo"),
    )
    # the spans are few; written once, they are read for the counts, the look-up and the result
    base = checkpointed(secret_spans(base, "_text").select(F.monotonically_increasing_id().alias("_row"), "_id", "_owner", "_repo", "_spans"))
    some = base.filter(F.size("_spans") > 0)
    each = some.select("_row", "_owner", "_repo", F.explode("_spans").alias("_s")).select(
        "_row", "_owner", "_repo", F.sha2("_s.value", 256).alias("_hash"), F.col("_s.value").alias("_value")
    )
    # checkpointed, so that the planner deals both sides of the join anew and can split a common value
    owned = checkpointed(ownership(each))
    copied = (F.col("_owners") >= widely) | (F.col("_repos") >= widely_repos)
    by_row = each.select("_row", "_hash").join(owned, "_hash").groupBy("_row").agg(
        F.count_if(~copied & F.col("_random")).alias("n_live"), F.count_if(copied).alias("n_copied"),
        F.max("_owners").alias("max_owners"), F.max("_repos").alias("max_repos"),
    )
    number_of = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    found = ["n_live", "n_copied", "max_owners", "max_repos"]
    nothing = [F.lit(0).cast("bigint").alias(c) if c[0] == "n" else F.lit(None).cast("bigint").alias(c) for c in found]
    rows = some.join(by_row, "_row").select("_id", "_spans", *found).unionByName(base.filter(F.size("_spans") == 0).select("_id", "_spans", *nothing))
    return rows.select(
        F.col("_id").alias(id_col), *(number_of(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.sha2(_names(F.filter("_spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _names(F.col("_spans")).alias("spans"), *found,
    )
