"""Rollouts kept as YAML with tagged objects: read into columns, and written.  For import; tables are Parquet or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEST = "struct<requirement:string,trace:string,label:string>"
#: A training rollout; absent fields read as null, and then as below.
ROLLOUT = (
    "struct<messages:array<struct<role:string,content:string,today_date:string,stopped_by_max_tokens_limit:boolean,prompt_tokens:array<int>,generated_tokens:array<int>,generated_token_logprobs:array<double>>>,"
    "ret:double,elapsed:double,cancelled:boolean,policy_token_info:struct<tokens:array<int>,log_probs:array<double>,is_output:array<boolean>>,"
    f"appworld_rollout_data:struct<task:struct<task_id:string>,eval_result:struct<success:boolean,difficulty:int,num_tests:int,passes:array<{_TEST}>,failures:array<{_TEST}>>,"
    "dataset_name:string,num_prompt_messages:int,n_execution_failed:int,n_no_code_found:int>>"
)


def _json(texts):
    """JSON of each YAML text: tagged objects as plain maps, times as they are written, "NaN" for what is no number."""
    import json

    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    Loader.add_multi_constructor("tag:yaml.org,2002:python/", lambda loader, _, node: loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node))

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return "NaN" if isinstance(x, float) and x != x else x

    return texts.map(lambda t: json.dumps(plain(yaml.load(t, Loader=Loader))), na_action="ignore")


def parsed(text: Column) -> Column:
    """A rollout's YAML as a struct: not cancelled, and no prompt messages, unless it says so; unknown counters are -1."""
    import pandas as pd

    def each(texts):
        return _json(texts)

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    raw = F.from_json(F.pandas_udf(each, "string")(text), ROLLOUT)
    data = raw["appworld_rollout_data"]
    filled = {"num_prompt_messages": 0, "n_execution_failed": -1, "n_no_code_found": -1}
    for name, default in filled.items():
        data = data.withField(name, F.coalesce(raw["appworld_rollout_data"][name], F.lit(default)))
    return raw.withField("cancelled", F.coalesce(raw["cancelled"], F.lit(False))).withField("appworld_rollout_data", data)


def written(rollout: Column) -> Column:
    """YAML of a rollout struct; JSON is YAML, so any reader of the one reads it."""
    return F.to_json(rollout)


def episodes(rollouts: DataFrame, column: str, experiment: str) -> DataFrame:
    """Rollouts as episode documents; a rollout that is kept was not cancelled."""
    r = F.col(column)
    data = r["appworld_rollout_data"]
    return rollouts.select(
        F.lit(experiment).alias("experiment"), data["task"]["task_id"].alias("task_id"), r["messages"].alias("chat_history"), data["eval_result"].alias("eval_result"),
        data["num_prompt_messages"].alias("num_prompt_messages"), data["n_execution_failed"].alias("n_execution_failed"), data["n_no_code_found"].alias("n_no_code_found"), F.lit(False).alias("cancelled"),
    )
