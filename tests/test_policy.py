"""Each policy rule on a configuration that breaks it and on one that does not."""

import json

from gritstone.operators import policy as P


def res(kind, body=None, name="x", **more):
    """A configuration of one resource and others by type (a list of names or bodies by name)."""
    out = {kind: {name: body or {}}}
    for k, v in more.items():
        out.setdefault(k, {}).update(v if isinstance(v, dict) else {n: {} for n in v})
    return {"resource": out}


def iam(**statement):
    return res(P.POLICY, {"policy": json.dumps({"Statement": [{"Effect": "Deny"}, {"Effect": "Allow", **statement}]})})


def group(side, *rules, name="x"):
    return res(P.GROUP, {side: [dict(zip(("cidr_blocks", "from_port", "to_port"), r)) for r in rules]}, name)


def fn(name="f", **body):
    return res(P.LAMBDA, body, name)


def many(kind, n, body=None):
    return {"resource": {kind: {f"x{i}": body or {} for i in range(n)}}}


def backend(**s3):
    return {"terraform": [{"required_providers": {}}, {"backend": [{"s3": [{"dynamodb_table": "t", "encrypt": True}, s3]}]}]}


OPEN = "0.0.0.0/0"
TAGS = {"tags": dict.fromkeys(["Project", "Environment", "ManagedBy", "CostCenter"], "v")}
#: By rule: breaks it, keeps it.
CASES = {
    "bucket_versioning": (res(P.BUCKET, {"versioning": [{"enabled": False}]}), res(P.BUCKET, {"versioning": [{}, {"enabled": True}]})),
    "bucket_encryption": (res(P.BUCKET), res(P.BUCKET, {"server_side_encryption_configuration": []})),
    "role_administrator": (res("aws_iam_role_policy_attachment", {"policy_arn": "arn:aws:iam::aws:policy/AdministratorAccess"}), res("aws_iam_role_policy_attachment", {"policy_arn": "arn:ReadOnly"})),
    "policy_wildcard": (iam(Action=["s3:Get", "*"], Resource="*"), iam(Action=["*"], Resource="arn:x")),
    "policy_many_actions": (iam(Action=[f"a:{i}" for i in range(21)]), iam(Action=[f"a:{i}" for i in range(20)])),
    "key_rotation": (res(P.KMS, {"enable_key_rotation": "true"}), res(P.KMS, {"enable_key_rotation": True})),
    "key_policy": (res(P.KMS), res(P.KMS, {"policy": "{}"})),
    "internet_gateway": (res("aws_internet_gateway"), {}),
    "ingress_open": (group("ingress", (["10.0.0.0/8"], 22), ([OPEN], 80)), group("ingress", ([OPEN], 443), (["10.0.0.0/8"], 22), ([OPEN],))),
    "egress_open": (group("egress", ([OPEN], 0, 0)), group("egress", ([OPEN], 0, 443))),
    "processor_network": (fn("a-processor"), fn("a-processor", vpc_config=[{}])),
    "function_timeout_900": (fn(timeout=901), fn(timeout=900)), "function_timeout_600": (fn(timeout=601), fn(timeout=600)),
    "document_memory": (fn("document-processor", memory_size=1023), fn("document-processor", memory_size=1024)),
    "trail_missing": ({}, res(P.TRAIL)), "trail_validation": (res(P.TRAIL), res(P.TRAIL, {"enable_log_file_validation": True})),
    "search_encryption": (res(P.SEARCH), res(P.SEARCH, {"encryption": {}})), "volume_encryption": (res("aws_ebs_volume"), res("aws_ebs_volume", {"encrypted": True})),
    "network_acl_missing": (res(P.VPC), res(P.VPC, aws_network_acl=["n"])), "endpoint_missing": (res(P.VPC), res(P.VPC, aws_vpc_endpoint=["n"])), "endpoints_advised": (res(P.VPC), res(P.VPC, aws_vpc_endpoint={})),
    "endpoint_policy": (res(P.ENDPOINT, {"vpc_endpoint_type": "Interface"}), res(P.ENDPOINT, {"vpc_endpoint_type": "Gateway"})),
    "required_tags": (res(P.KMS, {"tags": {"Project": "p"}}), res(P.KMS, TAGS)), "cost_tag_CostCenter": (res(P.SEARCH), res(P.SEARCH, TAGS)), "cost_tag_Environment": (res(P.VPC), res(P.VPC, TAGS)),
    "base_logging": (res(P.KB), res(P.KB, aws_cloudwatch_log_group=["l"])), "base_alarms": (res(P.KB), res(P.KB, aws_cloudwatch_metric_alarm=["l"])), "base_prompts": (res(P.KB), {}),
    "documents_replication": (res(P.BUCKET, name="my-documents"), res(P.BUCKET, name="my-documents", aws_s3_bucket_replication_configuration=["r"])),
    "analytics_direct_route": (group("egress", ([P.VIRGINIA], 1, 1), name="quicksight_vpc_conn"), group("egress", ([P.VIRGINIA], 1, 1), name="quicksight")),
    "analytics_open_egress": (group("egress", ([OPEN], 443, 443), name="quicksight"), group("egress", ([OPEN], 443, 443))),
    "lifecycle_policy": (res(P.BUCKET), res(P.BUCKET, aws_s3_bucket_lifecycle_configuration=["l"])), "lifecycle_tiering": (res(P.BUCKET), res(P.BUCKET, aws_s3_bucket_lifecycle_configuration=["l"])), "bucket_classes": (res(P.BUCKET), res(P.BUCKET, aws_s3_bucket_lifecycle_configuration=["l"])),
    "bucket_tiering": (res(P.BUCKET), res(P.BUCKET, aws_s3_bucket_intelligent_tiering_configuration=["l"])),
    "log_retention": (res(P.LOGS), res(P.LOGS, {"retention_in_days": 1})), "log_retention_advised": (res(P.LOGS), res(P.LOGS, {"retention_in_days": 1})),
    "log_retention_365": (res(P.LOGS, {"retention_in_days": 366}), res(P.LOGS, {"retention_in_days": 365})), "log_retention_90": (res(P.LOGS, {"retention_in_days": 91}), res(P.LOGS, {"retention_in_days": 90})),
    "state_versioning": (res(P.BUCKET, name="terraform-state"), res(P.BUCKET, {"versioning": [{"enabled": True}]}, "terraform-state")),
    "search_backups": (res(P.SEARCH), {}), "search_capacity": (res(P.SEARCH), {}), "search_usage": (res(P.SEARCH), {}),
    "flow_logs": (res(P.VPC), res(P.VPC, aws_flow_log=["f"])), "function_log_group": (fn("f"), res(P.LAMBDA, name="f", aws_cloudwatch_log_group=["/aws/lambda/f"])),
    "alarms_missing": (fn(), res(P.LAMBDA, aws_cloudwatch_metric_alarm=["a"])), "function_tracing": (fn(), fn(tracing_config=[])),
    "tracing_mode": (fn(tracing_config=[{"mode": "Off"}]), fn(tracing_config=[{"mode": "PassThrough"}])),
    "zones": (many("aws_subnet", 3, {"availability_zone": "a"}), {"resource": {"aws_subnet": {"a": {"availability_zone": "a"}, "b": {"availability_zone": "b"}}}}),
    "function_subnets": (fn(vpc_config=[{"subnet_ids": ["a"]}]), fn(vpc_config=[{"subnet_ids": ["a", "b"]}])),
    "vpc_name": (res(P.VPC, name="net"), res(P.VPC, name="my_vpc")), "bucket_name": (res(P.BUCKET, name="My_b"), res(P.BUCKET, name="my-b")),
    "backend_lock": (backend(encrypt=True), backend(encrypt=True, dynamodb_table="t")), "backend_encryption": (backend(dynamodb_table="t", encrypt="yes"), backend(dynamodb_table="t", encrypt=True)),
    "providers_pinned": ({"terraform": [{}]}, {"terraform": [{}, {"required_providers": {}}]}), "required_version": ({"terraform": [{"required_version": ">= 1.4"}]}, {"terraform": [{"required_version": ">= 1.5"}, {}]}),
    "two_providers": ({"provider": {"aws": {"a": {}}}}, {"provider": {"aws": [{}, {}]}}), "provider_region": ({"provider": {"aws": [{"region": "eu-west-1"}]}}, {"provider": {"aws": [{"region": "us-east-1"}, {}]}}),
    "peering_accept": (res(P.PEERING), res(P.PEERING, {"peer_region": "r"})), "peering_transfer": (res(P.PEERING, {"peer_region": "r"}), res(P.PEERING)),
    "peering_routes": (res(P.PEERING, aws_route={"a": {"vpc_peering_connection_id": "p"}, "b": {}}), res(P.PEERING, aws_route={"a": {"vpc_peering_connection_id": "p"}, "b": {"vpc_peering_connection_id": "p"}})),
    "document_timeout": (fn("document-processor", timeout=299), fn("document-processor", timeout=300)), "dead_letters": (fn("processor"), fn("processor", dead_letter_config=[{}])),
    "budget_advised": ({}, res(P.BUDGET)), "budget_required": ({}, res(P.BUDGET)), "budget_notification": (res(P.BUDGET), res(P.BUDGET, {"notification": [{}]})), "budget_threshold": (res(P.BUDGET, {"notification": [{"threshold": 80}, {"threshold": 101}]}), res(P.BUDGET, {"notification": [{"threshold": 100}]})),
    "variable_description": ({"variable": {"v": {"type": "string"}}}, {"variable": {"v": {"description": "d"}}}), "output_description": ({"output": {"v": {}}}, {"output": {"v": {"description": "d"}}}),
    "import_to": ({"import": [{"id": "i"}]}, {"import": [{"id": "i", "to": "t"}]}), "import_id": ({"import": [{"to": "i"}]}, {"import": [{"id": "i", "to": "t"}]}),
    "early_transition": (res(P.LIFECYCLE, {"rule": [{}, {"transition": [{"days": 90}, {"days": 29}]}]}), res(P.LIFECYCLE, {"rule": [{"transition": [{"days": 30}]}]})),
    "no_expiration": (res(P.LIFECYCLE, {"rule": [{"expiration": {}}, {}]}), res(P.LIFECYCLE, {"rule": [{"expiration": {}}]})),
    "function_memory": (fn(memory_size=3009), fn(memory_size=3008)), "reserved_concurrency": (fn(), fn(reserved_concurrent_executions=1)),
    "replication_transfer": (res(P.REPLICATION), {}), "replication_cost": (res(P.REPLICATION), {}), "nat_gateway": (res("aws_nat_gateway"), {}), "dashboards": (res("aws_cloudwatch_dashboard"), {}),
    "many_alarms": (many(P.ALARM, 51), many(P.ALARM, 50)), "many_keys": (many(P.KMS, 6), many(P.KMS, 5)), "savings_plan": (many(P.LAMBDA, 6), many(P.LAMBDA, 5)),
    "many_endpoints": (many(P.ENDPOINT, 11, {"vpc_endpoint_type": "Interface"}), many(P.ENDPOINT, 12, {"vpc_endpoint_type": "Gateway"})),
    "memory_for_short": (fn(memory_size=2048, timeout=60), fn(memory_size=2048, timeout=61)), "document_memory_advised": (fn("a-document", memory_size=1023), fn("a-document", memory_size=1024)),
    **{f"bucket_{f}": (res(P.BLOCK, {f: False}), res(P.BLOCK, {f: True})) for f in P.PUBLIC}, **{f"analytics_{f}": (res(P.BLOCK, {}, "quicksight"), res(P.BLOCK, {f: True}, "quicksight")) for f in P.PUBLIC},
}


def test_each_rule_both_ways(spark):
    names = [r.name for r in P.rules()]
    assert len(set(names)) == len(names) == 94 and set(names) - set(CASES) == {"estimate"} and not set(CASES) - set(names)
    plans = [(f"{rule}/{side}", json.dumps(doc)) for rule, pair in CASES.items() for side, doc in zip(("breaks", "keeps"), pair)]
    broken = {}
    for r in P.violations(spark.createDataFrame(plans, "plan string, config string")).collect():
        broken.setdefault(r.plan, []).append(r)
    for rule in CASES:
        assert rule in {r.rule for r in broken[f"{rule}/breaks"]}, rule
        assert rule not in {r.rule for r in broken.get(f"{rule}/keeps", [])}, rule
    assert all("estimate" in {r.rule for r in v} for v in broken.values()) and len(broken) == len(plans)


def test_details_and_odd_texts(spark):
    doc = group("ingress", ([OPEN], 80), ([OPEN], 22), ([OPEN], 80), ([OPEN], 443))
    plans = [(1, json.dumps(doc)), (1, json.dumps(res(P.VPC, name="vpc"))), (2, "no json"), (3, None), (4, "[1, 2]"), (5, '{"resource": {"aws_vpc": 7, "aws_kms_key": null}}'), (None, "{}")]
    got = P.violations(spark.createDataFrame(plans, "plan int, config string")).collect()
    assert sorted(r.detail for r in got if r.rule == "ingress_open") == ["22", "80"]
    assert sorted((r.name, r.detail) for r in got if r.rule == "required_tags") == [("vpc", t) for t in ("Environment", "ManagedBy", "Project")]
    empty = {r.rule for r in got if r.plan == 3}
    assert "trail_missing" in empty and all({r.rule for r in got if r.plan == p} == empty for p in (2, 4, None))
    assert P.violations(spark.createDataFrame([], "plan int, config string")).count() == 0
