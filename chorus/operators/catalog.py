"""Model catalog and request handling.

The catalog is configuration: its size is the number of configured models, not a function of
the data, so broadcasting it (or expanding it as an array literal per prompt) is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus import schemas as S
from chorus.functions import defaults as D
from chorus.functions import rules as R


def catalog_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """Flatten a provider config {provider: {enabled, models: [{id, name, role?}]}} to rows,
    keeping config order (``config_order``)."""
    rows, order = [], 0
    for provider, pc in config.get("providers", {}).items():
        for m in pc.get("models", []):
            rows.append((order, provider, bool(pc.get("enabled", False)), m["id"], m["name"], m.get("role")))
            order += 1
    return spark.createDataFrame(rows, S.CATALOG)


def observed_catalog(log: DataFrame, config: dict) -> DataFrame:
    """Catalog rows for the models seen in a log (first-seen order), with each provider's
    ``enabled`` flag and each model's role taken from ``config``."""
    from chorus.functions.agg import first_seen_key
    from chorus.operators.logview import response_fields
    ex = log.select("seq", F.posexplode(response_fields("provider", "model_id", "model_name")).alias("pos", "r"))
    seen = ex.groupBy("r.provider", "r.model_id", "r.model_name").agg(F.min(first_seen_key("seq", "pos")).alias("_first"))
    enabled = [p for p, pc in config.get("providers", {}).items() if pc.get("enabled", False)]
    roles = config.get("roles", {})
    role = F.lit(None).cast("string")
    for mid, rl in roles.items():
        role = F.when(F.col("model_id") == mid, F.lit(rl)).otherwise(role)
    w = Window.orderBy("_first")  # one row per model
    return seen.select(
        F.row_number().over(w).cast("int").alias("config_order"),
        "provider", F.col("provider").isin(enabled).alias("enabled"), "model_id", "model_name", role.alias("role"))


def model_catalog(catalog: DataFrame, api_keys: dict | None = None, keyless: tuple = ()) -> DataFrame:
    """S4 (with P17): enabled providers that have a non-blank key, or need none; role defaults
    to reasoning."""
    keys = [p for p, v in (api_keys or {}).items() if v is not None and str(v).strip() != ""]
    ok = F.col("enabled") & (F.col("provider").isin(keys + list(keyless)))
    return catalog.filter(ok).select(
        "config_order", "provider", "model_id", "model_name",
        F.coalesce("role", F.lit(R.DEFAULT_ROLE)).alias("role"))


def filter_by_role(active: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Models with one of the roles; None means all."""
    return active if roles is None else active.filter(F.col("role").isin(roles))


def strategy_list(spark: SparkSession) -> DataFrame:
    """Strategies with a title-cased display name."""
    df = spark.createDataFrame([(s,) for s in R.STRATEGIES], "id string")
    return df.select("id", F.initcap(F.replace("id", F.lit("_"), F.lit(" "))).alias("name"))


def platform_status(active: DataFrame, default_strategy: str = R.DEFAULT_STRATEGY) -> DataFrame:
    """Active providers (config order), active models and the default strategy, one row."""
    return active.agg(
        F.transform(F.array_sort(F.collect_set(F.struct(F.col("config_order"), F.col("provider")))),
                    lambda x: x["provider"]).alias("_p"),
        F.count(F.lit(1)).alias("active_models"),
    ).select(F.array_distinct("_p").alias("active_providers"), "active_models",
             F.lit(default_strategy).alias("synthesis_strategy"))


def select_judge(active: DataFrame, judge_provider: str, judge_model: str) -> DataFrame:
    """The configured judge if its provider is active, else the first active provider with
    the first active model; no row when nothing is active."""
    first = F.min(F.struct("config_order", "provider", "model_id"))
    has = F.max(F.col("provider") == judge_provider)
    return active.agg(first.alias("_f"), has.alias("_has")).filter(F.col("_f").isNotNull()).select(
        F.when(F.col("_has"), F.lit(judge_provider)).otherwise(F.col("_f.provider")).alias("judge_provider"),
        F.when(F.col("_has"), F.lit(judge_model)).otherwise(F.col("_f.model_id")).alias("judge_model"))


def validate_request(requests: DataFrame) -> DataFrame:
    """Reject unknown strategies and roles (the service's HTTP 400), as a reason column."""
    bad_roles = F.filter(F.coalesce("roles", F.array().cast("array<string>")), lambda r: ~r.isin(R.ROLES))
    reason = (F.when(~F.col("strategy").isin(R.STRATEGIES), F.concat(F.lit("Invalid strategy: "), F.col("strategy")))
              .when(F.size(bad_roles) > 0, F.concat(F.lit("Invalid role: "), F.get(bad_roles, 0))))
    return requests.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def request_defaults(requests: DataFrame, config_strategy: str | None = None,
                     system_prompt: str = D.SYSTEM_TEXT) -> DataFrame:
    """Missing strategy from config (else weighted_merge), missing system prompt from a
    constant."""
    return requests.withColumn("strategy", F.coalesce("strategy", F.lit(config_strategy or R.DEFAULT_STRATEGY))).withColumn(
        "system_prompt", F.coalesce("system_prompt", F.lit(system_prompt)))


def fan_out(prompts: DataFrame, models: list[dict]) -> DataFrame:
    """Every prompt with every active model. The active models are configuration (a short
    list), expanded per prompt as an array literal: a generator, not a join."""
    arr = F.array(*[F.struct(*[F.lit(m[k]).alias(k) for k in ("model_id", "model_name", "provider", "role")]) for m in models])
    return prompts.select("*", F.posexplode(arr).alias("model_pos", "m")).select("*", "m.*").drop("m")


def catalog_lookup(responses: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog row of each answer's model id (left, first match by config order)."""
    first = catalog.groupBy("model_id").agg(F.min(F.struct("config_order", "provider", "role")).alias("_c"))
    return responses.join(first, "model_id", "left").select(
        *responses.columns, F.col("_c.provider").alias("catalog_provider"), F.col("_c.role").alias("catalog_role"))


def request_params(model_id, temperature, max_tokens) -> Column:
    """request options per model id: o1/o3 ids drop temperature and use a completion-token
    limit; ids containing "opus" drop temperature and enable a 10,000-token thinking budget."""
    mid = F.col(model_id) if isinstance(model_id, str) else model_id
    o_series = mid.startswith("o1") | mid.startswith("o3")
    opus = mid.contains("opus")
    return F.struct(
        F.when(o_series | opus, F.lit(None).cast("double")).otherwise(temperature).alias("temperature"),
        F.when(o_series, F.lit(None).cast("int")).otherwise(max_tokens).alias("max_tokens"),
        F.when(o_series, max_tokens).alias("max_completion_tokens"),
        F.when(opus, F.lit(10000)).alias("thinking_budget_tokens"),
    )


def difficulty_steps(difficulty_level) -> Column:
    """number of reasoning steps max(2, level + 2)."""
    return F.greatest(F.lit(2), difficulty_level + 2)


def plan_names(difficulty_level, strategy_index) -> tuple:
    """level and strategy index -> names; the strategy order is the planner's own."""
    return (F.get(F.array(*[F.lit(d) for d in R.DIFFICULTIES]), difficulty_level),
            F.get(F.array(*[F.lit(s) for s in R.PLAN_STRATEGY_ORDER]), strategy_index))


def pseudo_quality_targets(score) -> Column:
    """(s, 0.9 s, 0.85 s, 0.95 s)."""
    s = F.col(score) if isinstance(score, str) else score
    return F.array(*[s * F.lit(f) for f in R.PSEUDO_QUALITY_FACTORS])
