"""Fill-in-middle transformation in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: the white space (ASCII) before a word and the word, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _draw(digest: str, group: int) -> Column:
    """The ``group``-th 8 hexadecimal digits of a digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cuts each text into prefix, middle and suffix and orders them for a model that fills in the middle.

    Adds n (units), form, prefix, middle, suffix and output to the key. All draws come from the SHA-256 of seed and key, so any run on
    any partitioning gives the same. ``rate`` per cent of the documents are transformed, ``spm_rate`` per cent of these into the order
    suffix, prefix, middle (spm), the others into prefix, suffix, middle (psm). Form is plain, the output the text itself and the parts
    null, for the others, for empty texts, and for texts that contain a sentinel.

    A projection: no shuffle, nothing leaves the JVM, and a text's units are the largest thing that a task holds. Null text counts as
    empty, a null key as a key without digits; repeated rows give repeated rows; an empty table gives no rows; columns other than the
    two named are not read, so none can clash.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    a, b = (F.pmod(_draw("digest", i), F.col("n") + 1) for i in (0, 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw("digest", 2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_draw("digest", 3) % 100 < spm_rate, "spm").otherwise("psm"))
    rows = rows.withColumn("first", F.least(a, b).cast("int")).withColumn("last", F.greatest(a, b).cast("int"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    rows = rows.select(
        "doc_id", "n", "form", "text",
        part(F.lit(1), F.col("first")).alias("prefix"),
        part(F.col("first") + 1, F.col("last") - F.col("first")).alias("middle"),
        part(F.col("last") + 1, F.col("n").cast("int") - F.col("last")).alias("suffix"),
    )
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.withColumn("output", F.coalesce(output, F.col("text"))).drop("text")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone: the parts stand between the sentinels, which no part contains."""
    mark = len(PREFIX)

    def between(after: str, before: str) -> Column:
        start = F.instr(F.col(output), after) + mark
        return F.substring(F.col(output), start, F.instr(F.col(output), before) - start)

    middle = F.substring(F.col(output), F.instr(F.col(output), MIDDLE) + mark, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(made: DataFrame) -> DataFrame:
    """Sizes of the parts, and digests of the outputs and of the texts restored from them."""
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )
