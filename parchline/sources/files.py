"""Readers and sinks for files around the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCR_TSV = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")]
    + [T.StructField("conf", T.DoubleType()), T.StructField("text", T.StringType())]
)


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognition output in tab-separated files: word rows with a confidence and visible text."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=OCR_TSV, quote="").withColumn("file", F.input_file_name())
    return raw.where("level = 5 AND conf >= 0 AND trim(text) <> ''")


def script_name(osd: Column) -> Column:
    """The script that an orientation report names, or null."""
    s = F.regexp_extract(osd, r"(?m)^Script:\s*(\S+)\s*$", 1)
    return F.when(s != "", s)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of files read as UTF-8 text, one row each."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def write_content_store(df: DataFrame, path: str, content: str = "content", role: str = "role") -> None:
    """Content-addressed files: one row per hash, in folders by role and the first two hex digits. Of rows with equal content the
    one with the smallest role stays; a second write of the same rows changes nothing that is there."""
    hashed = df.withColumn("sha256", F.sha2(content, 256))
    once = hashed.groupBy("sha256").agg(F.min_by(F.struct(*df.columns), F.struct(role)).alias("r")).select("sha256", "r.*")
    rows = once.withColumn("prefix", F.substring("sha256", 1, 2))
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select("sha256")
        rows = rows.join(there, "sha256", "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("append").partitionBy(role, "prefix").parquet(path)


def capture_verdict(content: Column) -> Column:
    """Whether raw bytes may be kept as a master: png and jxl are lossless, jpeg is refused, tiff depends on its compression."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FF0A") | head.startswith("0000000C4A584C20"), "jxl")
        .when(head.startswith("FFD8FF"), "refused: jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").otherwise("refused: unknown")
    )


def tiff_compression(content: bytes) -> int | None:
    """The value of tag 259 in the first directory of a TIFF; null if it cannot be read."""
    order = {b"II": "little", b"MM": "big"}.get(content[:2])
    if order is None or len(content) < 8:
        return None
    num = lambda a, n: int.from_bytes(content[a : a + n], order)
    at = num(4, 4)
    for k in range(num(at, 2) if at + 2 <= len(content) else 0):
        entry = at + 2 + 12 * k
        if entry + 12 > len(content):
            return None
        if num(entry, 2) == 259:
            return num(entry + 8, 2 if num(entry + 2, 2) == 3 else 4)
    return None


# fixed values: what tag 259 says of compressions that lose nothing, and of none
TIFF_LOSSLESS, TIFF_PLAIN = {5: "LZW", 8: "Deflate", 32946: "Deflate"}, 1


def capture_verdicts(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, verdict): ``capture_verdict`` with the compression of TIFF files: ``tiff LZW`` or ``tiff Deflate``, else refused."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for head, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if head == "tiff":
                    c = tiff_compression(data)
                    head = f"tiff {TIFF_LOSSLESS[c]}" if c in TIFF_LOSSLESS else "refused: tiff uncompressed" if c == TIFF_PLAIN else f"refused: tiff compression {c}"
                out.append(head)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "verdict"])

    schema = T.StructType([T.StructField("k", files.schema[key].dataType), T.StructField("verdict", T.StringType())])
    told = files.select(F.col(key), capture_verdict(F.col(content)).alias("head"), F.col(content))
    return told.select(key, "head", F.when(F.col("head") == "tiff", F.col(content)).alias("data")).mapInArrow(run, schema).withColumnRenamed("k", key)


def assert_local(path: str, network_points: list[str]) -> None:
    """Refuses a path on or below a network mount."""
    for p in network_points:
        if path == p or path.startswith(p.rstrip("/") + "/"):
            raise ValueError(f"{path} lies on the network mount {p}")


def verify_mount(spark: SparkSession, root: str, mount_id: str, marker: str = "MOUNT-ID") -> None:
    """Raises unless the marker file of a root names the mount that is meant, so that nothing is written where a mount dropped."""
    try:
        found = spark.read.text(f"{root.rstrip('/')}/{marker}").first()
    except Exception as e:
        raise OSError(f"no readable marker in {root}: the mount may have dropped") from e
    if found is None or found[0].strip() != mount_id:
        raise OSError(f"marker of {root} is {found and found[0]!r}, not {mount_id!r}")


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the rules they break. An unknown (null) result breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def copy_verified(df: DataFrame, path: str) -> tuple[int, int]:
    """Writes a copy of a table and reads it back: (rows, order-free checksum), equal on both sides or an error."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    # a decimal sum of hashes depends neither on order nor on partitioning and does not overflow
    digest = [F.count("*"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))]
    df.write.mode("overwrite").parquet(path)
    want, have = df.agg(*digest).first(), df.sparkSession.read.parquet(path).agg(*digest).first()
    if tuple(want) != tuple(have):
        raise OSError(f"copy differs: {want} / {have}")
    return int(have[0]), int(have[1])
