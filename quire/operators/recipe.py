"""From lines to the texts that are embedded: context for short lines, windows for long ones, keys, and the export of a plan.

A line of fewer than ``LEAST`` characters borrows the lines next to it in its section; one of fewer than ``EMBEDDABLE`` is
left out. Texts over ``WINDOW`` characters are cut at white space into overlapping windows. The key of a window is the
SHA-256 of its text, so equal texts have one vector, wherever they stand. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Fixed values of the recipe: characters of a meaningful and of an embeddable line, lines of context, characters of a window
# and of an overlap, windows of a line, and the mark that stands before every text.
LEAST, EMBEDDABLE, CONTEXT, WINDOW, OVERLAP, MOST, MARK = 20, 5, 2, 512, 128, 255, "[PASSAGE] "
RECORD = "key string, file_path string, ordinal int, window_no int, text string"


def with_context(lines: DataFrame, text: str = "text", before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """Adds ``context``: the text of a line, or for a short one its text with up to so many lines before and behind it that
    belong to its stretch of the same section; null for lines too short to be embedded.

    Needs file_path, section and ordinal. Null sections are a section of their own; null texts are empty. One shuffle by
    book and stretch of 4,096 ordinals, to which the lines at the edges of the neighbouring stretches are lent, so a book
    that holds a third of all lines is dealt with by many tasks.
    """
    block = F.col("ordinal").cast("long")
    own = lines.withColumn("_own", F.lit(True)).withColumn("_b", F.floor(block / _STRETCH))
    at = F.pmod(block, F.lit(_STRETCH))
    lent = own.select("*", at.alias("_at")).where((F.col("_at") < after) | (F.col("_at") >= _STRETCH - before)).withColumn("_own", F.lit(False))
    lent = lent.withColumn("_b", F.col("_b") + F.when(F.col("_at") < after, -1).otherwise(1)).drop("_at")
    rows = own.unionByName(lent)
    w = W.partitionBy("file_path", "_b").orderBy("ordinal")
    part = F.col(text)
    near = [_near(F.lag, k, text, w) for k in range(before, 0, -1)], [_near(F.lead, k, text, w) for k in range(1, after + 1)]
    joined = F.array_join(F.concat(_unbroken(near[0], True), F.array(F.coalesce(part, F.lit(""))), _unbroken(near[1], False)), " ")
    n = F.length(F.trim(part))
    context = F.when(n < EMBEDDABLE, None).when(n < LEAST, F.substring(F.trim(joined), 1, WINDOW)).otherwise(part)
    return rows.withColumn("context", context).where("_own").drop("_own", "_b")


_STRETCH = 4096


def _near(step, k: int, text: str, w) -> Column:
    """A neighbour as (same, t): whether it stands in the same section, and its text."""
    same = step("section", k).over(w).eqNullSafe(F.col("section")) & step(F.lit(1), k).over(w).isNotNull()
    return F.struct(same.alias("same"), F.coalesce(step(text, k).over(w), F.lit("")).alias("t"))


def _unbroken(near: list[Column], back: bool) -> Column:
    """The texts of the neighbours that no line of another section parts from the line."""
    if not near:
        return F.array().cast("array<string>")
    kept = []
    for i, x in enumerate(near):
        between = near[i:] if back else near[: i + 1]
        ok = between[0]["same"]
        for y in between[1:]:
            ok = ok & y["same"]
        kept.append(F.when(ok, x["t"]))
    return F.filter(F.array(*kept), lambda t: t.isNotNull())


def windows_of(text: Column, window: int = WINDOW, overlap: int = OVERLAP, most: int = MOST) -> Column:
    """The windows of a text: each ends at the last white space in the second half of ``window`` characters (at full
    length where there is none); the next one begins behind the first white space among the last ``overlap`` characters before that end."""
    if window // 2 <= overlap:
        raise ValueError("the overlap must be below half a window")
    gap = r"\s"
    t = F.trim(text)

    def step(state: Column, _: Column) -> Column:
        a = state["at"]
        rest = F.substring(t, a, F.lit(window))
        cut = F.length(F.regexp_extract(rest, rf"(?s)^(.*){gap}", 1))
        last = a + window > F.length(t)
        size = F.when(last, F.length(rest)).when(cut > window // 2, cut).otherwise(window)
        piece = F.regexp_replace(F.substring(rest, F.lit(1), size), rf"^{gap}+|{gap}+$", "")
        back = F.greatest(a + 1, a + size - overlap)
        tail = F.substring(t, back, a + size - back)
        into = F.length(F.regexp_extract(tail, rf"(?s)^(\S*{gap}+)", 1))
        follow = F.when((into > 0) & (into < F.length(tail)), back + into).otherwise(back)
        done = F.struct(F.lit(0).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))
        more = F.struct(follow.cast("int").alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))
        return F.when(a == 0, state).when(last, done).otherwise(more)

    turns = F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.length(t) / (window // 2 - overlap)).cast("int") + 1)))
    cut = F.aggregate(turns, F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(t) <= window, F.filter(F.array(t), lambda x: x != "")).otherwise(cut)


def key_of(text: Column) -> Column:
    """The key of an embedded text: the first 128 bits of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def embedded(lines: DataFrame, text: str = "text", notes: str | None = "notes", before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """(RECORD) of every window of every line: first those of its main text, then those of its notes, numbered through.

    Notes borrow nothing; those too short to be embedded are left out. Null texts and notes have no window. Rows are taken
    as they are, so lines must be there once.
    """
    rows = with_context(lines, text, before, after)
    note = F.filter(F.coalesce(F.col(notes), F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) >= EMBEDDABLE) if notes else F.array().cast("array<string>")
    every = F.slice(F.concat(windows_of(F.col("context")), F.flatten(F.transform(note, lambda x: windows_of(x)))), 1, MOST)
    marked = F.transform(every, lambda x: F.concat(F.lit(MARK), x))
    return rows.select("file_path", "ordinal", F.posexplode(marked).alias("window_no", "text")).select(key_of(F.col("text")).alias("key"), "file_path", "ordinal", "window_no", "text")


def plan(lines: DataFrame, have: DataFrame, path: str, text: str = "text", notes: str | None = "notes", before: int = CONTEXT, after: int = CONTEXT) -> dict[str, object]:
    """Write what an embedding run needs under ``path``, which must not exist: ``records`` (the place of every window),
    ``books`` (windows a book), ``embed`` (each text once whose key is not in ``have``), ``tombstones`` (keys of ``have`` that
    no window has any more). Returns the manifest: the number of rows of each, and a checksum that order doesn't change."""
    spark = lines.sparkSession
    embedded(lines, text, notes, before, after).write.parquet(f"{path}/windows")
    rows = spark.read.parquet(f"{path}/windows")
    known = have.select(F.lower("key").alias("key")).where("key IS NOT NULL").distinct()
    parts = {
        "records": rows.drop("text"),
        "books": rows.groupBy("file_path").agg(F.count("*").alias("windows"), F.count_distinct("key").alias("keys")),
        "embed": rows.groupBy("key").agg(F.min("text").alias("text")).join(known, "key", "left_anti"),
        "tombstones": known.join(rows.select("key").distinct(), "key", "left_anti"),
    }
    out: dict[str, object] = {}
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        n, check = back.agg(F.count("*"), F.sum(F.xxhash64(*sorted(back.columns)).cast("decimal(38,0)"))).first()
        out[name] = {"rows": n, "checksum": str(check or 0)}
    spark.createDataFrame([(k, v["rows"], v["checksum"]) for k, v in out.items()], "part string, rows long, checksum string").coalesce(1).write.parquet(f"{path}/manifest")
    return out


def faults(spark, path: str) -> list[str]:
    """What is wrong with a written plan: parts that differ from the manifest, records without a text or a key that isn't
    that of its text, texts that are embedded twice. Empty for a sound plan."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    out = []
    for r in read("manifest").collect():
        df = read(r.part)
        n, check = df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
        if (n, str(check or 0)) != (r.rows, r.checksum):
            out.append(f"{r.part} is not what the manifest says")
    if read("windows").where((F.col("key") != key_of(F.col("text"))) | F.col("text").isNull()).limit(1).count():
        out.append("a key isn't that of its text")
    if read("embed").groupBy("key").count().where("count > 1").limit(1).count():
        out.append("a text is embedded twice")
    return out


def rebuilt(lines: DataFrame, vectors: DataFrame, path: str, **recipe) -> dict[str, object]:
    """Write the vector set of these lines under ``path``, which must not exist, from vectors (key, embedding) that are there:
    one row for each key in use. Returns the number of keys in use and of those without a vector; a set with gaps, with
    vectors of different length or with repeated keys is not written."""
    need = embedded(lines, **recipe).select("key").distinct()
    found = need.join(vectors.select(F.lower("key").alias("key"), "embedding"), "key", "left")
    n, distinct, missing, least, most = found.agg(F.count("*"), F.count_distinct("key"), F.sum(F.col("embedding").isNull().cast("long")), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if missing or n != distinct or least != most:
        raise ValueError(f"{missing or 0} keys without a vector, {n - distinct} repeated, lengths {least} to {most}")
    found.write.parquet(path)
    return {"keys": distinct, "missing": 0}


