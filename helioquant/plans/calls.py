"""Queries over recorded model calls and conversations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from helioquant.functions.numeric import round_half_up
from helioquant.operators import calllog
from helioquant.plans import sqltext as q
from helioquant.plans.adapters import CALLS_SQL, call_log, flag, stream_lines, table

TOOL = "get_current_time"
REQUIRED = ("timezone",)


def _normalized(spark, sf):
    return calllog.normalize_responses(call_log(spark, sf))


def normalized_responses(spark, sf):
    tool = F.get("tool_use", F.lit(0))
    return _normalized(spark, sf).select(
        "call_id", "provider", "http_status",
        F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.size("tool_use"), F.lit(-1)).alias("n_tools"),
        F.coalesce(tool["id"], F.lit("")).alias("tool_id"),
        F.coalesce(tool["name"], F.lit("")).alias("tool_name"),
        F.coalesce(F.to_json(tool["arguments"]), F.lit("")).alias("arguments"),
        F.coalesce("stop_reason", F.lit("")).alias("stop_reason"),
        F.coalesce("input_tokens", F.lit(-1)).alias("input_tokens"),
        F.coalesce("total_tokens", F.lit(-1)).alias("total_tokens"),
        "latency_ms",
        F.coalesce("error", F.lit("")).alias("error"),
    )


NORMALIZED_SQL = f"""
WITH {CALLS_SQL}
SELECT call_id, provider, CASE WHEN usable THEN 200 ELSE 503 END AS http_status, model,
       CASE WHEN usable THEN text ELSE '' END AS text,
       CASE WHEN NOT usable THEN -1 WHEN has_tool THEN 1 ELSE 0 END AS n_tools,
       CASE WHEN usable AND has_tool THEN 't_' || conv_id || '_' || turn ELSE '' END AS tool_id,
       CASE WHEN usable AND has_tool THEN '{TOOL}' ELSE '' END AS tool_name,
       CASE WHEN NOT (usable AND has_tool) THEN ''
            WHEN turn = 0 AND provider <> 'anthropic' THEN '{{"raw_arguments":"{{\\"timezone\\": "}}'
            WHEN turn = 3 THEN '{{"timezone":"UTC"}}' ELSE '{{"tz":"UTC"}}' END AS arguments,
       CASE WHEN usable THEN stop_reason ELSE '' END AS stop_reason,
       CASE WHEN usable THEN n_in ELSE -1 END AS input_tokens,
       CASE WHEN usable THEN n_in + n_out ELSE -1 END AS total_tokens, latency_ms,
       CASE WHEN usable THEN '' ELSE 'No successful response' END AS error
FROM calls"""


def assembled_streams(spark, sf):
    out = calllog.assemble_streams(stream_lines(spark, sf))
    tool = F.get("tool_use", F.lit(0))
    return out.select(
        "call_id", "provider", "text", F.size("tool_use").alias("n_tools"),
        tool["id"].alias("tool_id"), tool["name"].alias("tool_name"),
        F.try_variant_get(tool["arguments"], "$['0']", "bigint").alias("first_argument"),
        F.try_variant_get(tool["arguments"], "$.end", "bigint").alias("end_argument"),
        "stop_reason", "input_tokens", "output_tokens", "total_tokens",
    )


STREAMS_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS call_id,
       CASE WHEN conv_id % 2 = 0 THEN 'anthropic' ELSE 'openai_compatible' END AS provider,
       string_agg(text, '' ORDER BY turn) AS text, 1 AS n_tools, 'c_' || conv_id AS tool_id,
       'lookup' AS tool_name, max(CASE WHEN turn = 0 THEN length(text) END) AS first_argument,
       0 AS end_argument, 'tool_use' AS stop_reason, count(*) AS input_tokens,
       max(turn) AS output_tokens, count(*) + max(turn) AS total_tokens
FROM conversations GROUP BY conv_id"""


def _attempts(spark, sf):
    """Orders as call attempts: the status follows from the order key, prices give the waits."""
    codes = (200, 200, 200, 400, 401, 403, 422, 429, 429, 500, 503, 204)
    n = len(codes) + 2
    at = F.pmod(F.col("o_orderkey"), F.lit(n))
    status = F.when(at == 0, F.lit(codes[0]))
    for i, code in enumerate(codes[1:], 1):
        status = status.when(at == i, F.lit(code))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_orderpriority").alias("provider"),
        status.alias("http_status"),
        F.when(at == len(codes), F.lit("timeout")).alias("error_kind"),
        F.when(at == 7, F.floor("o_totalprice").cast("string"))
        .when(at == 8, F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5")))
        .alias("retry_after"),
    )


def call_failures(spark, sf):
    out = calllog.failure_summary(calllog.classify_calls(_attempts(spark, sf)))
    return out.withColumn("retryable", flag("retryable"))


FAILURES_SQL = """
WITH a AS (SELECT o_orderpriority AS provider, o_orderkey % 14 AS i FROM orders),
c AS (SELECT provider, i, CASE WHEN i IN (0, 1, 2, 11) THEN 'ok' WHEN i IN (3, 5) THEN 'refused' WHEN i = 4 THEN 'authentication'
        WHEN i = 6 THEN 'unexpected_status' WHEN i IN (7, 8) THEN 'rate_limited' WHEN i IN (9, 10) THEN 'unavailable'
        WHEN i = 12 THEN 'timeout' ELSE 'transport_error' END AS failure_class FROM a)
SELECT provider, failure_class,
       CASE WHEN failure_class IN ('rate_limited', 'unavailable', 'timeout', 'transport_error') THEN 'true' ELSE 'false' END AS retryable,
       count(*) AS n_calls, count(CASE WHEN i = 7 THEN 1 END) AS n_with_wait
FROM c GROUP BY ALL"""


def model_usage(spark, sf):
    out = calllog.usage_rollup(_normalized(spark, sf), all_label="all", decimals=4)
    names = ("avg_latency_ms", "median_latency_ms", "max_latency_ms")
    return out.withColumns({n: F.coalesce(round_half_up(n, 3), F.lit(-1.0)) for n in names})


USAGE_SQL = f"""
WITH {CALLS_SQL},
labelled AS (SELECT model, n_in, n_out, latency_ms FROM calls WHERE usable
             UNION ALL SELECT 'all', n_in, n_out, latency_ms FROM calls WHERE usable)
SELECT model, count(*) AS calls, CAST(sum(n_in) AS BIGINT) AS input_tokens, CAST(sum(n_out) AS BIGINT) AS output_tokens,
       CAST(sum(n_in + n_out) AS BIGINT) AS total_tokens, {q.rounded(q.mean('latency_ms', 4), 3)} AS avg_latency_ms,
       {q.rounded('quantile_cont(latency_ms, 0.5)', 3)} AS median_latency_ms, {q.rounded('max(latency_ms)', 3)} AS max_latency_ms
FROM labelled GROUP BY model"""


def _checks(spark, sf):
    return calllog.tool_call_checks(_normalized(spark, sf), TOOL, REQUIRED)


def tool_checks(spark, sf):
    return _checks(spark, sf).select(
        "call_id", F.array_join("failed_checks", ",").alias("failed_checks")
    )


CHECKS_SQL = f"""
{CALLS_SQL},
k AS (
  SELECT *, usable AND has_tool AS present, usable AND has_tool AND turn IN (0, 3)
            AND NOT (turn = 0) AS args_ok FROM calls),
checked AS (
  SELECT call_id, model, present, args_ok, concat_ws(',',
    CASE WHEN NOT present THEN 'tool_present' END, CASE WHEN NOT present THEN 'tool_name' END,
    CASE WHEN NOT present THEN 'tool_id' END, CASE WHEN NOT args_ok THEN 'arguments_valid' END,
    CASE WHEN NOT usable OR stop_reason <> 'tool_use' THEN 'stop_reason' END,
    CASE WHEN NOT usable OR n_in <= 0 OR n_out <= 0 THEN 'tokens_positive' END,
    CASE WHEN latency_ms <= 0 THEN 'latency_positive' END,
    CASE WHEN NOT usable THEN 'one_usage_record' END) AS failed_checks FROM k)"""


def tool_reliability(spark, sf):
    out = calllog.tool_reliability(_checks(spark, sf))
    names = ("trigger_rate", "argument_accuracy")
    return out.withColumns({n: round_half_up(n, 6) for n in names})


TOOLS = (
    calllog.Tool(
        TOOL,
        "Current time of a time zone.",
        {"type": "object", "properties": {"timezone": {"type": "string"}}, "required": ["timezone"]},
    ),
)


def _requests(vendor, options):
    def run(spark, sf):
        out = calllog.build_requests(table(spark, sf, "conversations"), options, vendor)
        body = F.try_parse_json("payload")
        return out.select(
            "conv_id", "n_messages", "n_dropped_system", "roles",
            F.size(F.try_variant_get(body, "$.messages", "array<variant>")).alias("n_in_payload"),
            F.md5("payload").alias("payload_md5"),
        )

    return run


MESSAGES_OPTIONS = calllog.RequestOptions("model-a", system="Answer briefly.", tools=TOOLS)
COMPLETIONS_OPTIONS = calllog.RequestOptions(
    "model-b", system="Answer briefly.", tools=TOOLS, stream=True
)


def _requests_sql(vendor, options) -> str:
    """The payload put together in SQL; texts are quoted by the engine's own JSON function."""
    first = vendor == calllog.MESSAGES_VENDOR
    role = "CASE WHEN role IN ('user', 'tool') THEN 'user' ELSE 'assistant' END" if first else "role"
    kept = "role <> 'system'" if first else "true"
    lead = ""
    if not first:
        lead = json.dumps({"role": "system", "content": options.system}) + ", "
    head = json.dumps({"model": options.model})[:-1] + ', "messages": [' + lead
    tail: dict = {"max_tokens": 4096, "temperature": 0.0, "stream": not first}
    tool = TOOLS[0]
    if first:
        tail["system"] = options.system
        tail["tools"] = [{"name": tool.name, "description": tool.description, "input_schema": tool.parameters}]
    else:
        function = {"name": tool.name, "description": tool.description, "parameters": tool.parameters}
        tail |= {"tools": [{"type": "function", "function": function}], "tool_choice": "auto"}
        tail["stream_options"] = {"include_usage": True}
    end = "], " + json.dumps(tail)[1:]
    return f"""
    WITH m AS (SELECT conv_id, turn, {kept} AS kept, {role} AS r,
                      '{{"role": ' || to_json({role}) || ', "content": ' || to_json(text) || '}}' AS j FROM conversations)
    SELECT conv_id, count(CASE WHEN kept THEN 1 END) + {0 if first else 1} AS n_messages,
           count(CASE WHEN NOT kept THEN 1 END) AS n_dropped_system,
           coalesce(string_agg(CASE WHEN kept THEN r END, ',' ORDER BY turn), '') AS roles,
           count(CASE WHEN kept THEN 1 END) + {0 if first else 1} AS n_in_payload,
           md5('{head}' || coalesce(string_agg(CASE WHEN kept THEN j END, ', ' ORDER BY turn), '') || '{end}') AS payload_md5
    FROM m GROUP BY conv_id"""


QUERIES = {
    "normalize_responses": (normalized_responses, NORMALIZED_SQL),
    "assemble_streams": (assembled_streams, STREAMS_SQL),
    "call_failures": (call_failures, FAILURES_SQL),
    "usage_rollup": (model_usage, USAGE_SQL),
    "tool_call_checks": (tool_checks, f"WITH {CHECKS_SQL} SELECT call_id, failed_checks FROM checked"),
    "tool_reliability": (
        tool_reliability,
        f"""WITH {CHECKS_SQL} SELECT model, count(*) AS calls,
        {q.rounded('count(CASE WHEN present THEN 1 END) / CAST(count(*) AS DOUBLE)', 6)} AS trigger_rate,
        {q.rounded('count(CASE WHEN args_ok THEN 1 END) / CAST(nullif(count(CASE WHEN present THEN 1 END), 0) AS DOUBLE)', 6)} AS argument_accuracy
        FROM checked GROUP BY model""",
    ),
    "requests_messages": (
        _requests(calllog.MESSAGES_VENDOR, MESSAGES_OPTIONS),
        _requests_sql(calllog.MESSAGES_VENDOR, MESSAGES_OPTIONS),
    ),
    "requests_completions": (
        _requests(calllog.COMPLETIONS_VENDOR, COMPLETIONS_OPTIONS),
        _requests_sql(calllog.COMPLETIONS_VENDOR, COMPLETIONS_OPTIONS),
    ),
}
