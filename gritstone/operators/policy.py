"""policy rules over configurations, nested documents held as VARIANT.

A configuration is one JSON text: ``resource`` by type and name, ``variable``, ``output`` and ``provider`` by name,
``import`` and ``terraform`` lists. It is parsed once and exploded to (plan, type, name, body); facts that need a whole
configuration (which types it has, counts) are sums by plan. A rule is a row of a table: name, level, the types that it
looks at, a predicate over ``body``, ``name`` and the facts, and what it tells apart within a resource. All rules of a
type run in one pass; lists inside a body are met by quantifiers, not by exploding them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN = "@plan"


class Rule(NamedTuple):
    name: str
    level: str
    types: tuple[str, ...]
    #: The condition, or an array of what is told apart: one violation for each.
    test: Callable[[], Column]
    each: bool = False


# What a predicate is made of. ``v`` is the body unless a value inside it is given.


def at(path: str, v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("body") if v is None else v, f"$.{path}", "variant")


def truthy(x: Column) -> Column:
    """There, and not the boolean false."""
    return x.isNotNull() & ~F.coalesce((F.schema_of_variant(x) == "BOOLEAN") & ~F.try_variant_get(x, "$", "boolean"), F.lit(False))


def lacks(path: str, v: Column | None = None) -> Column:
    return ~truthy(at(path, v))


def is_true(path: str, v: Column | None = None) -> Column:
    x = at(path, v)
    return F.coalesce((F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"), F.lit(False))


def number(path: str, v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("body") if v is None else v, f"$.{path}", "double")


def words(path: str, v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("body") if v is None else v, f"$.{path}", "string")


def items(path: str, v: Column | None = None) -> Column:
    return F.coalesce(F.try_variant_get(F.col("body") if v is None else v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def some(path: str, test, v: Column | None = None) -> Column:
    return F.exists(items(path, v), lambda x: F.coalesce(test(x), F.lit(False)))


def named(part: str) -> Column:
    return F.contains(F.col("name"), F.lit(part))


def count(kind: str) -> Column:
    return F.coalesce(F.element_at("types", kind), F.lit(0))


def has(kind: str) -> Column:
    return F.map_contains_key("types", kind)


def from_anywhere(rule: Column, block: str = "0.0.0.0/0") -> Column:
    return some("cidr_blocks", lambda b: F.try_variant_get(b, "$", "string") == block, rule)


def statements() -> Column:
    """Of a policy whose text is JSON itself."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(words("policy")), "$.Statement", "array<variant>"), F.array().cast("array<variant>"))


# The rules with their types, limits and names.
BUCKET, LAMBDA, GROUP, KMS, VPC, SEARCH = "aws_s3_bucket", "aws_lambda_function", "aws_security_group", "aws_kms_key", "aws_vpc", "aws_opensearchserverless_collection"
BLOCK, LOGS, LIFECYCLE, KB, BUDGET, ALARM = "aws_s3_bucket_public_access_block", "aws_cloudwatch_log_group", "aws_s3_bucket_lifecycle_configuration", "aws_bedrockagent_knowledge_base", "aws_budgets_budget", "aws_cloudwatch_metric_alarm"
PEERING, ENDPOINT, REPLICATION, TRAIL, POLICY = "aws_vpc_peering_connection", "aws_vpc_endpoint", "aws_s3_bucket_replication_configuration", "aws_cloudtrail", "aws_iam_policy"
TAGGED = (VPC, BUCKET, LAMBDA, KMS)
VIRGINIA = "10.20.0.0/16"
REGIONS = ("ap-northeast-2", "us-east-1")
VERSIONS = ("1.5", "1.6", "1.7", "1.8")
PUBLIC = ("block_public_acls", "block_public_policy", "ignore_public_acls", "restrict_public_buckets")


def rules() -> list[Rule]:
    r: list[Rule] = []

    def add(name: str, level: str, types, test=lambda: F.lit(True), each: bool = False) -> None:
        r.append(Rule(name, level, (types,) if isinstance(types, str) else types, test, each))

    deny = lambda *a, **k: add(a[0], "deny", *a[1:], **k)
    warn = lambda *a, **k: add(a[0], "warn", *a[1:], **k)
    of = lambda v, kind="string": F.try_variant_get(v, "$", kind)

    # security
    deny("bucket_versioning", BUCKET, lambda: ~some("versioning", lambda x: truthy(at("enabled", x))))
    deny("bucket_encryption", BUCKET, lambda: lacks("server_side_encryption_configuration"))
    for flag in PUBLIC:
        deny(f"bucket_{flag}", BLOCK, lambda flag=flag: ~is_true(flag))
    deny("role_administrator", "aws_iam_role_policy_attachment", lambda: F.contains(words("policy_arn"), F.lit("AdministratorAccess")))
    deny("policy_wildcard", POLICY, lambda: F.exists(statements(), lambda s: F.coalesce((words("Effect", s) == "Allow") & some("Action", lambda a: of(a) == "*", s) & (words("Resource", s) == "*"), F.lit(False))))
    warn("policy_many_actions", POLICY, lambda: F.exists(statements(), lambda s: F.coalesce((words("Effect", s) == "Allow") & (F.size(items("Action", s)) > 20), F.lit(False))))
    deny("key_rotation", KMS, lambda: ~is_true("enable_key_rotation"))
    deny("key_policy", KMS, lambda: lacks("policy"))
    deny("internet_gateway", "aws_internet_gateway")
    deny("ingress_open", GROUP, lambda: F.array_distinct(F.transform(F.filter(items("ingress"), lambda x: F.coalesce(from_anywhere(x) & (number("from_port", x) != 443), F.lit(False))), lambda x: F.coalesce(words("from_port", x), F.lit("")))), each=True)
    warn("egress_open", GROUP, lambda: some("egress", lambda x: from_anywhere(x) & (number("from_port", x) == 0) & (number("to_port", x) == 0)))
    warn("processor_network", LAMBDA, lambda: named("processor") & lacks("vpc_config"))
    warn("function_timeout_900", LAMBDA, lambda: number("timeout") > 900)
    deny("document_memory", LAMBDA, lambda: named("document-processor") & (number("memory_size") < 1024))
    deny("trail_missing", PLAN, lambda: ~has(TRAIL))
    deny("trail_validation", TRAIL, lambda: ~is_true("enable_log_file_validation"))
    deny("search_encryption", SEARCH, lambda: lacks("encryption"))
    deny("volume_encryption", "aws_ebs_volume", lambda: ~is_true("encrypted"))
    warn("network_acl_missing", PLAN, lambda: (count(VPC) > 0) & ~has("aws_network_acl"))
    deny("endpoint_missing", PLAN, lambda: (count(VPC) > 0) & ~has(ENDPOINT))
    warn("endpoint_policy", ENDPOINT, lambda: (words("vpc_endpoint_type") == "Interface") & lacks("policy"))
    deny("required_tags", TAGGED, lambda: F.filter(F.array(*[F.when(lacks(f"tags.{t}"), F.lit(t)) for t in ("Project", "Environment", "ManagedBy")]), lambda t: t.isNotNull()), each=True)
    warn("base_logging", KB, lambda: ~has(LOGS))
    warn("documents_replication", BUCKET, lambda: named("documents") & ~has(REPLICATION))
    # analytics network
    deny("analytics_direct_route", GROUP, lambda: named("quicksight") & named("vpc_conn") & some("egress", lambda x: from_anywhere(x, VIRGINIA)))
    deny("analytics_open_egress", GROUP, lambda: named("quicksight") & some("egress", from_anywhere))
    for flag in PUBLIC:
        deny(f"analytics_{flag}", BLOCK, lambda flag=flag: named("quicksight") & ~is_true(flag))
    # compliance
    warn("lifecycle_policy", BUCKET, lambda: ~has(LIFECYCLE))
    deny("log_retention", LOGS, lambda: lacks("retention_in_days"))
    warn("log_retention_365", LOGS, lambda: number("retention_in_days") > 365)
    deny("state_versioning", BUCKET, lambda: named("terraform-state") & ~some("versioning", lambda x: truthy(at("enabled", x))))
    warn("search_backups", SEARCH)
    deny("flow_logs", VPC, lambda: ~has("aws_flow_log"))
    deny("function_log_group", LAMBDA, lambda: ~F.array_contains("log_groups", F.concat(F.lit("/aws/lambda/"), F.col("name"))))
    warn("alarms_missing", PLAN, lambda: (count(LAMBDA) > 0) & ~has(ALARM))
    warn("function_tracing", LAMBDA, lambda: lacks("tracing_config"))
    deny("tracing_mode", LAMBDA, lambda: some("tracing_config", lambda x: words("mode", x) != "Active") & some("tracing_config", lambda x: words("mode", x) != "PassThrough"))
    deny("zones", PLAN, lambda: (count("aws_subnet") > 0) & (F.col("zones") < 2))
    warn("function_subnets", LAMBDA, lambda: some("vpc_config", lambda x: truthy(x)) & some("vpc_config", lambda x: at("subnet_ids", x).isNotNull() & (F.size(items("subnet_ids", x)) < 2)))
    warn("vpc_name", VPC, lambda: ~named("vpc"))
    warn("bucket_name", BUCKET, lambda: ~F.col("name").rlike("^[a-z0-9][a-z0-9-]*[a-z0-9]$"))
    backends = lambda: F.flatten(F.transform(F.flatten(F.transform(F.col("terraform"), lambda t: items("backend", t))), lambda b: items("s3", b)))
    deny("backend_lock", PLAN, lambda: F.exists(backends(), lambda b: lacks("dynamodb_table", b)))
    deny("backend_encryption", PLAN, lambda: F.exists(backends(), lambda b: ~is_true("encrypt", b)))
    deny("providers_pinned", PLAN, lambda: ~F.exists("terraform", lambda t: truthy(at("required_providers", t))))
    warn("required_version", PLAN, lambda: F.exists("terraform", lambda t: words("required_version", t).isNotNull() & ~words("required_version", t).rlike("|".join(v.replace(".", r"\.") for v in VERSIONS))))
    warn("two_providers", PLAN, lambda: count("@provider") < 2)
    deny("provider_region", "@provider", lambda: truthy(at("region")) & ~F.coalesce(words("region").isin(*REGIONS), F.lit(False)))
    warn("peering_accept", PEERING, lambda: ~is_true("auto_accept") & lacks("peer_region"))
    warn("peering_routes", PLAN, lambda: (count(PEERING) > 0) & (F.col("peering_routes") < 2))
    deny("search_capacity", SEARCH)
    deny("document_timeout", LAMBDA, lambda: named("document-processor") & (number("timeout") < 300))
    warn("dead_letters", LAMBDA, lambda: named("processor") & lacks("dead_letter_config"))
    warn("budget_advised", PLAN, lambda: ~has(BUDGET))
    warn("lifecycle_tiering", BUCKET, lambda: ~has(LIFECYCLE))
    warn("variable_description", "@variable", lambda: lacks("description"))
    warn("output_description", "@output", lambda: lacks("description"))
    warn("import_to", "@import", lambda: lacks("to"))
    warn("import_id", "@import", lambda: lacks("id"))
    # cost
    warn("bucket_tiering", BUCKET, lambda: ~has(LIFECYCLE) & ~has("aws_s3_bucket_intelligent_tiering_configuration"))
    warn("early_transition", LIFECYCLE, lambda: some("rule", lambda x: some("transition", lambda t: number("days", t) < 30, x)))
    warn("no_expiration", LIFECYCLE, lambda: some("rule", lambda x: lacks("expiration", x)))
    warn("function_memory", LAMBDA, lambda: number("memory_size") > 3008)
    warn("reserved_concurrency", LAMBDA, lambda: lacks("reserved_concurrent_executions"))
    warn("function_timeout_600", LAMBDA, lambda: number("timeout") > 600)
    warn("search_usage", SEARCH)
    warn("replication_transfer", REPLICATION)
    warn("endpoints_advised", PLAN, lambda: (count(VPC) > 0) & ~has(ENDPOINT))
    warn("log_retention_90", LOGS, lambda: number("retention_in_days") > 90)
    warn("log_retention_advised", LOGS, lambda: lacks("retention_in_days"))
    warn("many_alarms", PLAN, lambda: count(ALARM) > 50)
    warn("many_keys", PLAN, lambda: count(KMS) > 5)
    warn("many_endpoints", PLAN, lambda: F.col("interfaces") > 10)
    warn("nat_gateway", "aws_nat_gateway")
    for tag in ("CostCenter", "Environment"):
        deny(f"cost_tag_{tag}", (*TAGGED, SEARCH), lambda tag=tag: lacks(f"tags.{tag}"))
    warn("base_alarms", KB, lambda: ~has(ALARM))
    warn("base_prompts", KB)
    deny("budget_required", PLAN, lambda: ~has(BUDGET))
    warn("budget_notification", BUDGET, lambda: lacks("notification"))
    warn("budget_threshold", BUDGET, lambda: some("notification", lambda x: number("threshold", x) > 100))
    warn("memory_for_short", LAMBDA, lambda: (number("memory_size") >= 2048) & (number("timeout") <= 60))
    warn("document_memory_advised", LAMBDA, lambda: named("document") & (number("memory_size") < 1024))
    warn("bucket_classes", BUCKET, lambda: ~has(LIFECYCLE))
    warn("dashboards", "aws_cloudwatch_dashboard")
    warn("peering_transfer", PEERING, lambda: truthy(at("peer_region")))
    warn("replication_cost", REPLICATION)
    warn("savings_plan", PLAN, lambda: count(LAMBDA) > 5)
    warn("estimate", PLAN)
    return r


def resources(plans: DataFrame, key: str, text: str) -> DataFrame:
    """(plan, type, name, body) and facts by plan; text that is no JSON object raises no error and has the facts of an
    empty configuration."""
    spark = plans.sparkSession
    doc = plans.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("plan"), F.try_parse_json(text).alias("doc"))

    def exploded(df: DataFrame, v: str, *keep: str) -> DataFrame:
        return df.lateralJoin(spark.tvf.variant_explode(F.col(v).outer())).select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias("k"), F.col("value").alias("v"))

    types = exploded(doc.select("plan", at("resource", F.col("doc")).alias("r")), "r", "plan").withColumnRenamed("k", "type")
    rows = exploded(types.withColumnRenamed("v", "r"), "r", "plan", "type").select("plan", "type", F.col("k").alias("name"), F.col("v").alias("body"))
    for kind in ("variable", "output", "import", "provider"):
        path = "provider.aws" if kind == "provider" else kind
        own = exploded(doc.select("plan", at(path, F.col("doc")).alias("r")), "r", "plan").select("plan", F.lit(f"@{kind}").alias("type"), F.col("k").alias("name"), F.col("v").alias("body"))
        rows = rows.unionByName(own)
    listed = types.select("plan", "type", F.lit(0).alias("n")).unionByName(rows.select("plan", "type", F.lit(1).alias("n"))).groupBy("plan", "type").agg(F.sum("n").alias("n"))
    listed = listed.groupBy("plan").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("types"))
    kind = F.col("type")
    facts = rows.groupBy("plan").agg(
        F.collect_set(F.when(kind == LOGS, F.col("name"))).alias("log_groups"),
        F.count_distinct(F.when(kind == "aws_subnet", words("availability_zone"))).alias("zones"),
        F.count_if((kind == ENDPOINT) & (words("vpc_endpoint_type") == "Interface")).alias("interfaces"),
        F.count_if((kind == "aws_route") & truthy(at("vpc_peering_connection_id"))).alias("peering_routes"),
    )
    whole = doc.select("plan", items("terraform", F.col("doc")).alias("terraform")).join(listed, "plan", "left").join(facts, "plan", "left")
    none = {"types": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")), "log_groups": F.array().cast("array<string>"), "zones": F.lit(0), "interfaces": F.lit(0), "peering_routes": F.lit(0)}
    whole = whole.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    body = F.lit(None).cast("variant")
    return rows.join(whole, "plan").select("plan", "type", "name", "body", "terraform", *none).unionByName(whole.select("plan", F.lit(PLAN).alias("type"), F.lit("").alias("name"), body.alias("body"), "terraform", *none))


def violations(plans: DataFrame, key: str = "plan", text: str = "config", table: list[Rule] | None = None) -> DataFrame:
    """(key, rule, level, type, name, detail): each rule that a resource, or a configuration (type ``@plan``), breaks."""
    by_type: dict[str, list[Column]] = {}
    for rule in table or rules():
        test = rule.test()
        details = F.coalesce(test, F.array().cast("array<string>")) if rule.each else F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        for kind in rule.types:
            by_type.setdefault(kind, []).append(F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.level).alias("level"), details.alias("details")))
    found = None
    for kind, hits in by_type.items():
        found = F.when(F.col("type") == kind, F.array(*hits)) if found is None else found.when(F.col("type") == kind, F.array(*hits))
    rows = resources(plans, key, text).where(F.col("type").isin(*by_type)).select("plan", "type", "name", F.explode(found).alias("x"))
    return rows.select(F.col("plan.key").alias(key), "x.rule", "x.level", "type", "name", F.explode("x.details").alias("detail"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
