"""Readers and writers of splits, episodes, evaluations, result lines, checkpoints and history tables.

Every path is a Hadoop path (local, object store, ...) that Spark's own readers open.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources import archives

_TEST = "struct<requirement:string,trace:string,label:string>"
#: An episode document; absent fields read as null.
EPISODE = (
    "experiment_name string, task struct<task_id:string,datetime:string,instruction:string,supervisor:struct<first_name:string,last_name:string,phone_number:string,email:string>>, "
    "chat_history array<struct<role:string,content:string,today_date:string,ipython:boolean,stopped_by_max_tokens_limit:boolean,prompt_tokens:array<int>,generated_tokens:array<int>,generated_token_logprobs:array<double>>>, "
    f"eval_result struct<success:boolean,difficulty:int,num_tests:int,passes:array<{_TEST}>,failures:array<{_TEST}>,num_interactions:int>, "
    "num_prompt_messages int, n_execution_failed int, n_no_code_found int, cancelled boolean"
)
EVALUATION = f"struct<individual:map<string,struct<success:boolean,difficulty:int,num_tests:int,passes:array<{_TEST}>,failures:array<{_TEST}>>>,aggregate:map<string,double>>"


def read_split(spark: SparkSession, folder: str, name: str, denylist: DataFrame | None = None) -> DataFrame:
    """Ids of a split, or of several joined by ``_and_``; blank lines go, and ids of the denylist if given."""
    paths = [f"{folder}/{part}.txt" for part in name.split("_and_")]
    ids = spark.read.text(paths).select(F.trim("value").alias("task_id")).filter("task_id <> ''")
    return ids if denylist is None else ids.join(denylist, "task_id", "left_anti")


def write_split(ids: DataFrame, path: str, column: str = "task_id") -> None:
    """One id a line, in one file: splits are small by nature."""
    ids.select(F.col(column).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def write_episodes(episodes: DataFrame, path: str) -> None:
    episodes.write.mode("overwrite").json(path)


def read_episodes(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Episodes with defaults; the counters' -1 (unknown) becomes null.  An absent id is the parent folder's name."""
    raw = spark.read.schema(EPISODE).option("multiLine", multiline).json(path)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/(?:logs/)?[^/]+$", 1)
    unknown = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("n_execution_failed", "n_no_code_found")}
    return raw.withColumn("task_id", F.coalesce("task.task_id", folder)).withColumns(unknown | {"cancelled": F.coalesce("cancelled", F.lit(False)), "num_prompt_messages": F.coalesce("num_prompt_messages", F.lit(0))})


def messages(episodes: DataFrame) -> DataFrame:
    """A row for each message after the prompt."""
    out = episodes.select("task_id", "num_prompt_messages", F.posexplode("chat_history").alias("msg_idx", "m"))
    return out.filter("msg_idx >= num_prompt_messages").select("task_id", "msg_idx", "m.*")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """A row for each task of an evaluation file."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", EVALUATION).alias("e"))
    return docs.select(F.explode("e.individual").alias("task_id", "r")).select("task_id", "r.*")


def parse_pipe_table(lines: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """Rows of a printed table: cells between pipes; rules and the header (not a number in the last cell) go."""
    cells = F.transform(F.split(F.trim(F.regexp_replace(column, r"^\s*\||\|\s*$", "")), r"\|"), lambda x: F.trim(x))
    rows = lines.select(cells.alias("c")).filter(F.size("c") == len(columns)).filter(F.element_at("c", -1).try_cast("double").isNotNull())
    return rows.select(*(F.element_at("c", k + 1).alias(n) for k, n in enumerate(columns)))


def result_line(metrics: dict[str, str]) -> Column:
    """``name: value`` for each metric column, in order."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in metrics.items()))


def read_result_line(lines: DataFrame, names: list[str], order: str, column: str = "value") -> DataFrame:
    """Metrics of the last line that isn't blank; null where a name is missing or no number follows."""
    last = lines.filter(F.trim(column) != "").agg(F.max_by(column, order).alias("line"))
    return last.select(*(F.regexp_extract("line", rf"\b{n}:\s*([-+0-9.eE]+)", 1).try_cast("double").alias(n) for n in names))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path, folder, name and time of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "modificationTime")


def complete_checkpoints(files: DataFrame) -> DataFrame:
    """Checkpoint folders with a completion mark, or a trainer state and an adapter, and their iterations."""
    names = files.groupBy("folder").agg(F.collect_set("name").alias("names"))
    has = lambda *n: F.arrays_overlap("names", F.array(*map(F.lit, n)))
    done = has("done.txt", ".complete") | (has("trainer_state.json") & has("adapter_model.safetensors", "adapter_model.bin"))
    return names.filter(done).select("folder", F.regexp_extract("folder", r"(\d+)$", 1).try_cast("int").alias("iteration")).filter("iteration IS NOT NULL")


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_table(frames: list[DataFrame], path: str) -> None:
    """One CSV with a header of all columns in the order first seen."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Written unless it is there."""
    rows.write.mode("ignore").json(path)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Rank, member name and text of every member of zip archives named r<rank>.zip.

    A task holds the bytes of one archive, and a few members at a time.
    """

    def unpack(batches):
        import pyarrow as pa

        def batch(where, rows):
            return pa.RecordBatch.from_arrays([pa.array([where] * len(rows)), *(pa.array(c, pa.string()) for c in zip(*rows))], names=["path", "member", "text"])

        for found in batches:
            for where, content in zip(found.column("path").to_pylist(), found.column("content")):
                rows, size = [], 0
                for name, text in archives.unpacked(content.as_buffer()):
                    rows.append((name, text))
                    size += len(text)
                    if len(rows) == 10_000 or size > archives.PIECE:
                        yield batch(where, rows)
                        rows, size = [], 0
                if rows:
                    yield batch(where, rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "path string, member string, text string").select(F.regexp_extract("path", r"r(\d+)\.zip$", 1).try_cast("int").alias("rank"), "member", "text")


def write_archives(members: DataFrame, path: str) -> None:
    """Zip archives r<rank>.zip of the members (rank, member, text) of each rank, in the order of their names.

    The task that packs an archive writes it, a piece at a time, by Spark's own writer; the driver only gives the
    files their names.  An archive is one file and so one task's work; Parquet is the better form for what is large.
    """
    spark = members.sparkSession

    def pack(batches):
        from itertools import groupby

        import pyarrow as pa

        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3))))
        for rank, own in groupby(rows, key=lambda r: r[0]):
            for n, piece in enumerate(archives.packed((name, text) for _, name, text in own)):
                yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([n], pa.int64()), pa.array([piece], pa.binary())], names=["rank", "n", "piece"])

    named = members.select(F.col("rank").cast("int"), F.col("member").cast("string"), F.col("text").cast("string"))
    pieces = named.repartition("rank").sortWithinPartitions("rank", "member").mapInArrow(pack, "rank int, n long, piece binary")
    # the writer wants rows by rank; sorted by place as well, it takes them as they come
    lines = pieces.sortWithinPartitions("rank", "n").select("rank", F.col("piece").cast("string").alias("value"))
    packing = f"{path}/_packing-{uuid.uuid4().hex}"
    lines.write.partitionBy("rank").option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(packing)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(conf)
    for folder in fs.listStatus(hadoop(packing)):
        if not folder.isDirectory():
            continue
        rank = folder.getPath().getName().removeprefix("rank=")
        target = hadoop(f"{path}/r{rank if rank.lstrip('-').isdigit() else None}.zip")
        (written,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        fs.delete(target, False)
        if not fs.rename(written, target):
            raise OSError(f"cannot rename {written} to {target}")
    fs.delete(hadoop(packing), True)


def rollout_members(members: DataFrame) -> DataFrame:
    """Archive members with what they are (rollout or scenario) and their scenario and rollout indices; others go."""
    kind = F.regexp_extract("member", r"(rollout|scenario)\.r\d+\.", 1)
    index = lambda k: F.regexp_extract("member", rf"(?:rollout|scenario)\.r\d+\.(\d+)(?:\.(\d+))?\.(?:yaml|json)$", k).try_cast("int")
    found = members.withColumns({"kind": kind, "scenario": index(1), "rollout": index(2)})
    return found.filter((F.col("kind") != "") & F.col("scenario").isNotNull())


def rollout_shape(members: DataFrame) -> DataFrame:
    """One row: the numbers of ranks, of scenarios and of rollouts of each."""
    return members.agg(*((F.max(c) + 1).alias(n) for c, n in (("rank", "num_ranks"), ("scenario", "num_scenarios"), ("rollout", "num_rollouts"))))


def linear_index(rank: Column, scenario: Column, rollout: Column, num_scenarios: Column, num_rollouts: Column) -> Column:
    """Place of (rank, scenario, rollout) when all are counted, rollouts fastest."""
    return (rank * num_scenarios + scenario) * num_rollouts + rollout


def from_linear(index: Column, num_scenarios: Column, num_rollouts: Column) -> Column:
    """(rank, scenario, rollout) at a place."""
    whole = lambda a, b: F.floor(a / b).cast("int")
    return F.struct(whole(index, num_scenarios * num_rollouts).alias("rank"), (whole(index, num_rollouts) % num_scenarios).alias("scenario"), (index % num_rollouts).cast("int").alias("rollout"))


def split_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """split and n: the ids of each split, null for one whose file is not there."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)\.txt(?:/[^/]*)?$", 1).alias("name"))
    ids = spark.read.option("recursiveFileLookup", True).text(folder).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt(?:/[^/]*)?$", 1).alias("name"), F.trim("value").alias("v"))
    counts = there.distinct().join(ids.filter("v <> ''").groupBy("name").agg(F.count("*").alias("_n")), "name", "left")
    wanted = spark.createDataFrame([(n,) for n in names], "split string")
    return wanted.join(counts.select(F.col("name").alias("split"), F.coalesce("_n", F.lit(0)).alias("n")), "split", "left")


def last_checkpoint(complete: DataFrame) -> DataFrame:
    """The complete checkpoint of the largest number."""
    return complete.orderBy(F.col("iteration").desc()).limit(1)


def append_line(line: DataFrame, path: str) -> None:
    """Append lines (one text column) to a folder of text files."""
    line.write.mode("append").text(path)


def gpu_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """index, memory_used_mib and utilization_gpu of each line of a probe; lines of other than three cells go."""
    cells = F.transform(F.split(column, ","), lambda c: F.trim(c))
    return lines.select(cells.alias("c")).filter("size(c) = 3").select(*(F.col("c")[k].cast("int").alias(n) for k, n in enumerate(("index", "memory_used_mib", "utilization_gpu"))))


def idle_devices(targets: DataFrame, status: DataFrame, most_memory: int, most_utilization: int) -> DataFrame:
    """Target devices with idle and why not: missing, or what is in use; targets has the column index."""
    joined = targets.join(status, "index", "left")
    missing = F.col("memory_used_mib").isNull()
    busy = (F.col("memory_used_mib") > most_memory) | (F.col("utilization_gpu") > most_utilization)
    used = F.format_string("gpu%d=mem%dMiB/util%d%%", "index", "memory_used_mib", "utilization_gpu")
    return joined.select("index", (~missing & ~busy).alias("idle"), F.when(missing, F.format_string("gpu%d=missing", "index")).when(busy, used).alias("busy"))


#: Counters that a trainer's state must have.
STATE = ("iterations_completed", "output_tokens_generated", "rollouts_generated", "global_step")


def write_state(state: DataFrame, path: str) -> None:
    """One row of counters."""
    state.select(*STATE).coalesce(1).write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The counters; an error names those that are missing."""
    row = spark.read.schema(", ".join(f"{c} long" for c in STATE)).json(path)
    lost = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in STATE))
    bad = F.raise_error(F.concat(F.lit("missing in the trainer's state: "), lost)).cast("long")
    return row.select(F.when(lost != "", bad).otherwise(F.col(STATE[0])).alias(STATE[0]), *STATE[1:])


def collisions(new: DataFrame, installed: DataFrame, key: str = "task_id") -> DataFrame:
    """Ids that are installed already; a data set may be installed if there are none."""
    return new.select(key).distinct().join(installed, key, "left_semi")


def publish(spark: SparkSession, tasks: DataFrame, source: str, target: str, key: str = "task_id") -> int:
    """Copy the folders of tasks from one place to another, each once; an error if any is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    ids = [r[0] for r in tasks.select(key).distinct().collect()]
    to = path(target).getFileSystem(conf)
    there = [i for i in ids if to.exists(path(f"{target}/{i}"))]
    if there:
        raise ValueError(f"already installed: {', '.join(sorted(there))}")
    from_ = path(source).getFileSystem(conf)
    for i in ids:
        jvm.org.apache.hadoop.fs.FileUtil.copy(from_, path(f"{source}/{i}"), to, path(f"{target}/{i}"), False, conf)
    return len(ids)


def remove(spark: SparkSession, tasks: DataFrame, target: str, key: str = "task_id") -> int:
    """Delete the folders of installed tasks; how many were there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(bool(fs.delete(path(f"{target}/{r[0]}"), True)) for r in tasks.select(key).distinct().collect())


def latest_file(files: DataFrame, name: str) -> DataFrame:
    """path of the file changed last of those whose name matches a pattern; null if there is none."""
    return files.filter(F.col("name").rlike(name)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
