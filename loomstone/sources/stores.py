"""Readers and writers of JSON lines and of keyed stores."""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; a temporary one only where that is unset and the driver is the only machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomstone-")
    return f"{found.rstrip('/')}/loomstone-stores-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON-lines file; a missing file has none, a malformed line or a missing required key raises."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing key {c}"))).otherwise(F.col(c)))
    return df


def read_url_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """URLs of a text file, without blank lines and # comments."""
    df = spark.read.text(path).select(F.trim("value").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    return df if limit is None else df.limit(limit)


_PIN = "struct<revid:bigint,pinned_url:string,pinned_at:string>"


def save_snapshot(pins: DataFrame, path: str) -> None:
    """pins(url, revid, pinned_url, pinned_at) as a folder of lines, each a JSON object from an address to its pin. Pins are neither gathered nor merged, so an address may stand in several lines; one without address stands under ''."""
    pin = F.struct("revid", "pinned_url", "pinned_at")
    pins.select(F.to_json(F.create_map(F.coalesce("url", F.lit("")), pin)).alias("value")).write.text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(url, revid, pinned_url, pinned_at) of a JSON object from address to pinned revision: a file is one object, a folder holds one a line; a missing path has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "url string, revid long, pinned_url string, pinned_at string")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    lines = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    text = spark.read.text(path, wholetext=not lines).select(F.from_json("value", f"map<string,{_PIN}>", {"mode": "FAILFAST"}).alias("m"))
    url = F.when((F.col("key") != "") | F.col("p.pinned_url").isNotNull(), F.col("key"))
    return text.select(F.explode("m").alias("key", "p")).select(url.alias("url"), "p.revid", "p.pinned_url", "p.pinned_at")


def tile_image_path(slug, tile_id, folder: str = "images"):
    """Where a tile's image is kept."""
    return F.concat(F.lit(f"{folder}/"), slug, F.lit("__"), tile_id, F.lit(".png"))


def save_tile_images(tiles: DataFrame, folder: str) -> DataFrame:
    """(id, image_path) of tiles(page_slug, tile_id, image); an image that is there already is not written again. Files are written whole under a temporary name, then renamed."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, image in zip(b["id"], b["image"]):
                path = f"{base}/{name}.png"
                if image is not None and store.get_file_info(path).type == fs.FileType.NotFound:
                    temporary = f"{path}.{uuid.uuid4().hex}"
                    with store.open_output_stream(temporary, compression=None) as out:
                        out.write(bytes(image))
                    store.move(temporary, path)
            yield b.assign(image_path=[f"{folder}/{n}.png" for n in b["id"]])[["id", "image_path"]]

    return tiles.select(F.concat("page_slug", F.lit("__"), "tile_id").alias("id"), "image").mapInPandas(run, "id string, image_path string")


def compress_images(spark: SparkSession, source: str, target: str, scale: float = CONFIG.image_scale) -> int:
    """Write each PNG of a folder smaller, under its own name; how many. Needs an imaging library on the executors."""
    if not 0 < scale < 1:
        raise ValueError("scale must lie between 0 and 1")

    def run(batches):
        from PIL import Image  # not part of the engine
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                image = Image.open(io.BytesIO(content))
                out = io.BytesIO()
                image.resize(tuple(max(1, round(s * scale)) for s in image.size), Image.LANCZOS).save(out, "PNG")
                with store.open_output_stream(f"{base}/{path.rsplit('/', 1)[-1]}", compression=None) as f:
                    f.write(out.getvalue())
            yield b[["path"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(source)
    return files.select("path", "content").mapInPandas(run, "path string").count()


def save_jsonl(rows: DataFrame, path: str) -> None:
    """Overwrite a JSON-lines store."""
    rows.write.mode("overwrite").json(path)


def append_attempt(attempted: DataFrame, examples: DataFrame, root: str) -> None:
    """Log ids as attempted, then append the examples that came of them: what fails between is tried no second time."""
    attempted.select("id").write.mode("append").json(f"{root}/attempted")
    examples.write.mode("append").json(f"{root}/examples")


def attempted_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids of examples and of attempts."""
    parts = [spark.read.schema("id string").json(f"{root}/{p}") for p in ("examples", "attempted") if _exists(spark, f"{root}/{p}")]
    return parts[0].union(parts[1]).distinct() if len(parts) == 2 else parts[0].distinct() if parts else spark.createDataFrame([], "id string")


def with_existing(new: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of new with the columns of those that exist under their key, rows still to be made)."""
    return new.select(key).join(existing, key), new.join(existing.select(key), key, "left_anti")


def save_results(rows: DataFrame, path: str, *by: str) -> None:
    """Evaluation results as JSON, a folder for each value of `by`."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def last_of_key(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """For equal keys, the value of the last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def unseen(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys not there yet, and of equal new keys one."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def append_unseen(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Idempotent append to a JSON store; the number of rows written."""
    spark = rows.sparkSession
    new = unseen(rows, spark.read.schema(rows.schema).json(path), keys) if _exists(spark, path) else rows.dropDuplicates(keys)
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    new.unpersist()
    return n


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows by key, new ones winning; of several rows of a key in one of them, the one whose JSON sorts last."""
    both = old.withColumn("run", F.lit(0)).unionByName(new.withColumn("run", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col("run").desc(), F.to_json(F.struct(*old.columns)).desc())
    return both.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k", "run")


def pinned(urls: DataFrame, snapshot: DataFrame) -> DataFrame:
    """urls(url) with the address to read: the pinned one where there is one; of several pins of an address the first by name, so each row comes out once."""
    pins = snapshot.groupBy("url").agg(F.min("pinned_url").alias("pinned_url"))
    return urls.join(pins, "url", "left").withColumn("read_url", F.coalesce("pinned_url", "url"))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with value, misses without duplicates) of requests(key, ...) in cache(key, value)."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti").dropDuplicates(["key"])
