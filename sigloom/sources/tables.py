"""Readers and writers of sessions, epochs, metrics, models and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sigloom import schemas
from sigloom.operators.windows import merge_streams
from sigloom.schemas import require_columns
from sigloom.streaming.states import Action, Machine

KNOWN_ACTIONS = ("PREDICT", "PARTIAL_FIT", "FIT", "COLLECT_FOR_TRAIN")


def read_samples(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SAMPLES).format(source).load(path)


def read_channels(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CHANNELS).format(source).load(path)


def read_markers(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """Markers; a table of raw payloads (``payload`` array) has its code at index 1."""
    df = spark.read.format(source).load(path)
    if "payload" in df.columns:
        df = df.withColumn("code", F.col("payload")[1].cast("int"))
    return require_columns(df, ["session_id", "ts", "code"]).select("session_id", F.col("ts").cast("double"), F.col("code").cast("int"))


def read_task_json(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, pos, sample_type) of task scripts; the session is the folder's name."""
    script = spark.read.option("multiLine", True).schema("samples array<struct<sample_type: string>>").json(path)
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return script.select(session.alias("session_id"), F.posexplode("samples").alias("pos", "s")).select("session_id", "pos", F.col("s.sample_type").alias("sample_type"))


def discover_sessions(spark: SparkSession, root: str, required: tuple[str, ...] = ("samples.parquet", "markers.parquet"), only: list[str] | None = None) -> DataFrame:
    """(session_id, ``complete``) of the folders below ``root``, sorted; a session without a required file is not complete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    # What follows the root's full path, whatever its name is.
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    parts = files.select(F.split(F.substring("path", F.lit(len(full) + 2), F.length("path")), "/").alias("p")).filter(F.size("p") > 1)
    found = parts.groupBy(F.col("p")[0].alias("session_id")).agg(F.collect_set(F.col("p")[1]).alias("names"))
    if only is not None:
        found = found.filter(F.col("session_id").isin(only))
    complete = reduce(lambda a, b: a & b, [F.array_contains("names", x) for x in required])
    return found.select("session_id", complete.alias("complete")).orderBy("session_id")


def write_epochs(df: DataFrame, path: str, key: str = "subject_id") -> None:
    require_columns(df, [key, "sample", "n_channels", "n_times"]).write.mode("overwrite").partitionBy(key).parquet(path)


def read_epochs(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["sample", "n_channels", "n_times", *(fields or [])])


def calibrated_cache(df: DataFrame, path: str, use: bool, save: bool) -> DataFrame:
    """What an earlier run saved, if ``use`` and there is such; else ``df``, saved first if ``save``."""
    spark = df.sparkSession
    if use:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if not save:
        return df
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per part of a fitted step."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, parts: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The named parts, each with the columns it must have; an error if one is not there."""
    return {name: require_columns(spark.read.parquet(f"{path}/{name}"), columns) for name, columns in parts.items()}


def result_envelope(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``value``: the fields as one JSON object, of type ``data`` unless they say another."""
    kept = [F.col(c) for c in fields if c != "type"]
    kind = F.coalesce(F.col("type"), F.lit("data")) if "type" in df.columns else F.lit("data")
    return df.withColumn("value", F.to_json(F.struct(kind.alias("type"), *kept)))


def write_results_stream(df: DataFrame, path: str, checkpoint: str):
    """Append results as lines of JSON; the running query."""
    return df.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_samples(spark: SparkSession, path: str, schema: str = schemas.SAMPLES, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_markers(spark: SparkSession, path: str, schema: str = schemas.MARKERS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(samples: DataFrame, markers: DataFrame) -> DataFrame:
    """Both recorded streams in order of time, samples first at the same time."""
    return merge_streams(samples, markers)


def parse_state_machine(config: dict) -> tuple[Machine, list[Action], list[dict]]:
    """Machine, actions and windowing of a configuration; unknown actions, actions without a group of their own or their state's, and unknown states are errors."""
    states = config["states"]
    transitions, labels, groups, actions = {}, {}, {}, []
    for name, state in states.items():
        transitions[name] = {int(code): to for code, to in (state.get("transitions") or {}).items()}
        if unknown := [to for to in transitions[name].values() if to not in states]:
            raise ValueError(f"{name} goes to unknown states: {', '.join(unknown)}")
        if "label" in state:
            labels[name] = state["label"]
        if "group" in state:
            groups[name] = state["group"]
        for when in ("entry", "exit"):
            actions += [_action(f"{when}:{name}", a, state.get("group")) for a in state.get(f"{when}_actions") or []]
        for to, more in (state.get("transition_actions") or {}).items():
            actions += [_action(f"transition:{name}:{to}", a, state.get("group")) for a in more]
    windowing = config.get("windowing") or []
    for w in windowing:
        if w["action"] not in KNOWN_ACTIONS:
            raise ValueError(f"unknown action {w['action']}")
    return Machine(config["initial_state"], transitions, labels, groups), actions, windowing


def _action(trigger: str, raw: dict, group: str | None) -> Action:
    """An action for its own group, else for that of the state whose rules name it."""
    if raw.get("action") not in KNOWN_ACTIONS:
        raise ValueError(f"unknown action {raw.get('action')}")
    if not (raw.get("group") or group):
        raise ValueError(f"{trigger}: {raw['action']} has no group")
    return Action(trigger, raw["action"], raw.get("group") or group, float(raw.get("delay_seconds", 0)))


def load_state_machine(path: str) -> tuple[Machine, list[Action], list[dict]]:
    """A YAML configuration (needs PyYAML)."""
    import yaml

    with open(path) as file:
        return parse_state_machine(yaml.safe_load(file))


def dimension_tables(spark: SparkSession, machine: Machine, actions: list[Action], windowing: list[dict]) -> dict[str, DataFrame]:
    """A machine as small tables to join with."""
    moves = [(s, code, to) for s, codes in machine.transitions.items() for code, to in codes.items()]
    return {
        "states": spark.createDataFrame([(s, machine.labels.get(s), machine.groups.get(s)) for s in machine.transitions], "state string, class_label int, grp string"),
        "transitions": spark.createDataFrame(moves, "state string, code int, next string"),
        "actions": spark.createDataFrame([(a.trigger, a.action, a.group, a.delay) for a in actions], "trigger string, action string, grp string, delay double"),
        "windowing": spark.createDataFrame([(w["window_size"], w["action"], w["window_step"]) for w in windowing], "size int, action string, step int"),
    }
