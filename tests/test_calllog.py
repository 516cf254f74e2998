from __future__ import annotations

import json
import statistics
import random

import pytest
from pyspark.sql import functions as F

from helioquant.operators import calllog
from helioquant.operators.calllog import COMPLETIONS_VENDOR as B
from helioquant.operators.calllog import MESSAGES_VENDOR as A

LOG = "call_id string, provider string, http_status int, body string, latency_ms double"


def log_row(call_id, vendor, body, status=200, latency=12.5):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return (call_id, vendor, status, text, latency)


def choice(message, finish="stop", **top):
    return {"model": "m-b", "choices": [{"message": message, "finish_reason": finish}], **top}


def call(arguments, **more):
    return {"function": {"name": "read_meter", "arguments": arguments}, **more}


@pytest.fixture
def normalized(spark):
    rows = [
        log_row("a_text", A, {"model": "m-a", "content": [{"type": "text", "text": "All "}, {"type": "text", "text": "well."}],
                              "stop_reason": "end_turn", "usage": {"input_tokens": 42, "output_tokens": 18}}),
        log_row("a_tool", A, {"model": "m-a", "content": [{"type": "text", "text": "Looking."},
                              {"type": "tool_use", "id": "t1", "name": "read_meter", "input": {"meter": "M-4"}}, {"type": "other"}],
                              "stop_reason": "tool_use", "usage": {"input_tokens": 120, "output_tokens": 45}}),
        log_row("a_odd", A, {"content": [{"type": "tool_use"}], "stop_reason": "refusal"}),
        log_row("b_text", B, choice({"content": "940 W/m²"}, usage={"prompt_tokens": 30, "completion_tokens": 12})),
        log_row("b_tool", B, choice({"content": None, "tool_calls": [call('{"meter": "M-11"}', id="c9")]}, "tool_calls",
                                    usage={"prompt_tokens": 80, "completion_tokens": 25})),
        log_row("b_args", B, choice({"tool_calls": [call({"meter": 1}), call('{"meter": '), call("")]}, "function_call")),
        log_row("b_null", B, choice({"content": "", "tool_calls": None}, None)),
        log_row("b_long", B, choice({"content": "x"}, "length")),
        log_row("b_filter", B, choice({"content": "x"}, "content_filter")),
        log_row("b_empty", B, {"choices": []}),
        log_row("bad_json", A, "{oops"),
        log_row("failed", A, None, status=503),
    ]
    return calllog.normalize_responses(spark.createDataFrame(rows, LOG), default_model="m-default")


def tools(row):
    return [(t.id, t.name, json.loads(str(t.arguments.toJson()))) for t in row.tool_use]


def test_normalized_records(normalized):
    out = {r.call_id: r for r in normalized.collect()}
    assert (out["a_text"].text, out["a_text"].text_blocks) == ("All well.", ["All ", "well."])
    assert (out["a_text"].stop_reason, out["a_text"].total_tokens, out["a_text"].model) == ("end_turn", 60, "m-a")
    assert tools(out["a_tool"]) == [("t1", "read_meter", {"meter": "M-4"})] and out["a_tool"].stop_reason == "tool_use"
    assert tools(out["a_odd"]) == [("", "", {})]
    assert (out["a_odd"].stop_reason, out["a_odd"].input_tokens, out["a_odd"].model) == ("unknown", 0, "m-default")
    assert (out["b_text"].text, out["b_text"].stop_reason, out["b_text"].total_tokens) == ("940 W/m²", "end_turn", 42)
    assert tools(out["b_tool"]) == [("c9", "read_meter", {"meter": "M-11"})] and out["b_tool"].text_blocks == []
    assert tools(out["b_args"]) == [
        ("call_0", "read_meter", {"meter": 1}), ("call_1", "read_meter", {"raw_arguments": '{"meter": '}), ("call_2", "read_meter", {}),
    ]
    assert [out[c].stop_reason for c in ("b_args", "b_null", "b_long", "b_filter")] == ["tool_use", "end_turn", "max_tokens", "unknown"]
    assert out["b_null"].tool_use == [] and out["b_null"].text == ""
    for name, error in (("b_empty", "No completion choices"), ("bad_json", "Malformed JSON"), ("failed", "No successful")):
        assert out[name].error.startswith(error) and out[name].tool_use is None and out[name].total_tokens is None


def test_checks_and_reliability(normalized):
    again = normalized.where("call_id = 'b_tool'").withColumn("call_id", F.lit("twice"))
    slow = normalized.where("call_id = 'a_tool'").withColumns({"call_id": F.lit("no_time"), "latency_ms": F.lit(0.0)})
    table = normalized.unionByName(again).unionByName(again).unionByName(slow)
    checks = calllog.tool_call_checks(table, "read_meter", ["meter"])
    out = {r.call_id: r.failed_checks for r in checks.collect()}
    assert out["a_tool"] == [] and out["b_tool"] == []
    assert out["a_text"] == ["tool_present", "tool_name", "tool_id", "arguments_valid", "stop_reason"]
    assert out["a_odd"] == ["tool_name", "tool_id", "arguments_valid", "stop_reason", "tokens_positive"]
    assert out["twice"] == ["one_usage_record"] and out["no_time"] == ["latency_positive"]
    assert out["b_args"] == ["tokens_positive"] and out["failed"] == [
        "tool_present", "tool_name", "tool_id", "arguments_valid", "stop_reason", "tokens_positive", "one_usage_record",
    ]
    rates = {r.model: r for r in calllog.tool_reliability(checks).collect()}
    assert rates["m-a"].trigger_rate == pytest.approx(2 / 3) and rates["m-a"].argument_accuracy == 1.0
    assert rates["m-default"].argument_accuracy == 0.0


def test_usage(normalized):
    out = {r.model: r for r in calllog.usage_rollup(normalized, all_label="all").collect()}
    assert (out["m-a"].calls, out["m-a"].input_tokens, out["m-a"].output_tokens, out["m-a"].total_tokens) == (2, 162, 63, 225)
    assert (out["all"].calls, out["all"].total_tokens, out["all"].avg_latency_ms) == (9, 372, 12.5)


def test_usage_medians_and_means_from_all_values(spark):
    rows = [("a", 1.25), ("a", 1.75), ("a", 9.0), ("b", 1.5), ("b", 2.0), (None, 1.5), (None, 700.0), ("c", None)]
    rows += [("d", float(i % 7) + i / 1000) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "model string, latency_ms double").selectExpr(
        "model", "latency_ms", "cast(null as string) as error", "1L as input_tokens", "2L as output_tokens", "3L as total_tokens"
    )
    out = {r.model: r for r in calllog.usage_rollup(df, all_label="all").collect()}
    assert set(out) == {"a", "b", "c", "d", None, "all"}
    for model in out:
        values = sorted(v for m, v in rows if v is not None and model in (m, "all"))
        assert out[model].calls == sum(model in (m, "all") for m, _ in rows)
        if not values:
            assert out[model].median_latency_ms is None and out[model].avg_latency_ms is None
            continue
        assert out[model].median_latency_ms == pytest.approx(statistics.median(values))
        assert out[model].avg_latency_ms == pytest.approx(statistics.fmean(values))
    assert {r.model for r in calllog.usage_rollup(df).collect()} == {"a", "b", "c", "d", None}
    assert calllog.usage_rollup(df.limit(0), all_label="all").collect() == []


def stream(call_id, vendor, events, start=0):
    return [(call_id, vendor, start + i, e if isinstance(e, str) else "data: " + json.dumps(e)) for i, e in enumerate(events)]


def text_a(text):
    return {"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}}


def json_a(piece):
    return {"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": piece}}


def tool_a(call_id, name):
    return {"type": "content_block_start", "content_block": {"type": "tool_use", "id": call_id, "name": name}}


def delta_b(finish=None, usage=None, **delta):
    out = {"choices": [{"delta": delta, "finish_reason": finish}]}
    return out | {"usage": usage} if usage is not None else out


def calls_b(index, arguments=None, call_id=None, name=None):
    function = {k: v for k, v in (("name", name), ("arguments", arguments)) if v is not None}
    return delta_b(tool_calls=[{"index": index, "function": function} | ({"id": call_id} if call_id else {})])


STOP_A = {"type": "content_block_stop"}


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 1000])
def test_streams(spark, chunk_rows):
    def started(n):
        return {"type": "message_start", "message": {"usage": {"input_tokens": n}}}

    def ended(reason, n):
        return {"type": "message_delta", "delta": {"stop_reason": reason}, "usage": {"output_tokens": n}}

    rng = random.Random(chunk_rows)
    rows, want = [], {}
    for i in range(12):
        # Text in random pieces, tools with arguments in random pieces, noise between.
        words = [f"w{rng.randrange(99)} " for _ in range(rng.randrange(1, 6))]
        made = [(f"id{i}-{k}", f"tool{k}", {"v": rng.randrange(999), "q": "é" * k}) for k in range(rng.randrange(3))]
        a, b = [started(100 + i)], []
        for w in words:
            a += [text_a(w), ": ping"] if rng.random() < 0.3 else [text_a(w)]
            b.append(delta_b(content=w))
        for k, (call_id, name, arguments) in enumerate(made):
            text = json.dumps(arguments)
            cut = rng.randrange(len(text))
            a += [tool_a(call_id, name), json_a(text[:cut]), json_a(text[cut:]), STOP_A]
            b += [calls_b(k, text[:cut], call_id, name), "data: {not json", calls_b(k, text[cut:])]
        a += [ended("tool_use" if made else "end_turn", 7 * i), "data: [DONE]", text_a("behind the end")]
        b += [delta_b("tool_calls" if made else "stop", {"prompt_tokens": 100 + i, "completion_tokens": 7 * i}), "data: [DONE]", delta_b(content="no")]
        for name, vendor, events in ((f"a{i}", A, a), (f"b{i}", B, b)):
            lines = stream(name, vendor, events)
            rows += lines + rng.sample(lines, 2)  # some lines were logged again
            want[name] = ("".join(words), "tool_use" if made else "end_turn", 100 + i, 7 * i, made)
    lines = spark.createDataFrame(rows, "call_id string, provider string, seq long, line string")
    out = {r.call_id: r for r in calllog.assemble_streams(lines.repartition(3), chunk_rows).collect()}
    assert {k: (r.text, r.stop_reason, r.input_tokens, r.output_tokens, tools(r)) for k, r in out.items()} == want


def whole_stream(vendor, events):
    """Tools of a stream, event by event."""
    out, block, turn = [], None, {}
    for e in events:
        if vendor == A:
            if e["type"] == "content_block_start":
                block = [e["content_block"].get("id"), e["content_block"].get("name"), ""]
            elif e["type"] == "content_block_stop" and block:
                out += [block] if block[0] and block[1] else []
                block = None
            elif e["type"] == "content_block_delta" and block:
                block[2] += e["delta"]["partial_json"]
        else:
            for c in e["choices"][0]["delta"].get("tool_calls", ()):
                own = turn.setdefault(c["index"], ["", "", ""])
                own[0] = c.get("id") or own[0]
                own[1] = c["function"].get("name") or own[1]
                own[2] += c["function"].get("arguments", "")
            if e["choices"][0]["finish_reason"]:
                out += turn.values()
                turn = {}
    return [(i, n, json.loads(t) if t else {}) for i, n, t in out]


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 1000])
def test_runs_join_to_the_whole(spark, chunk_rows):
    rng = random.Random(99)
    rows, want = [], {}
    for i in range(60):
        # Starts, digits and stops in any order: blocks left open, stops of nothing, repeated indexes.
        n = rng.randrange(1, 25)
        a = [
            rng.choice([tool_a(f"i{k}", rng.choice(["n", "m", None])), json_a(str(rng.randrange(1, 10))), json_a("1"), STOP_A])
            for k in range(n)
        ]
        b = [
            delta_b("tool_calls") if rng.random() < 0.2
            else calls_b(rng.randrange(3), str(rng.randrange(1, 10)), rng.choice([None, f"i{k}"]), rng.choice([None, "n"]))
            for k in range(n)
        ]
        for name, vendor, events in ((f"a{i}", A, a), (f"b{i}", B, b)):
            rows += stream(name, vendor, events, start=rng.randrange(9))
            want[name] = whole_stream(vendor, events)
    lines = spark.createDataFrame(rows, "call_id string, provider string, seq long, line string")
    out = {r.call_id: tools(r) for r in calllog.assemble_streams(lines, chunk_rows).collect()}
    assert out == want


@pytest.mark.parametrize("vendor", [A, B])
def test_a_call_of_a_million_lines(spark, vendor):
    n = 1_000_000
    first, last = (
        (tool_a("t", "tool"), STOP_A) if vendor == A else (calls_b(0, "", "t", "tool"), delta_b("tool_calls"))
    )
    piece = json.dumps(json_a("7") if vendor == A else calls_b(0, "7"))
    lines = spark.range(n).selectExpr(
        "'c' as call_id", f"'{vendor}' as provider", "id as seq",
        f"concat('data: ', case id when 0 then '{json.dumps(first)}' when {n - 1} then '{json.dumps(last)}' else '{piece}' end) as line",
    )
    runs = calllog.stream_runs(lines, n // 100).selectExpr("count(*) as n", "max(size(tools)) as events").first()
    assert (runs.n, runs.events) == (100, 2)
    (row,) = calllog.assemble_streams(lines, n // 100).selectExpr("size(tool_use) as n", "tool_use[0].id as id", "length(to_json(tool_use[0])) as size").collect()
    assert (row.n, row.id) == (1, "t") and row["size"] >= n - 2


def test_broken_streams(spark):
    rows = stream("a", A, [text_a("kept"), tool_a("x1", "plain"), STOP_A, tool_a("x2", "spoilt"), json_a('{"n": 4'), STOP_A, tool_a("x3", "open"), json_a("{}")])
    rows += stream("b", B, [delta_b(content="part"), calls_b(0, "[oops", "y1", "spoilt")])
    lines = spark.createDataFrame(rows, "call_id string, provider string, seq long, line string")
    out = {r.call_id: r for r in calllog.assemble_streams(lines).collect()}
    assert out["a"].text == "kept" and tools(out["a"]) == [("x1", "plain", {}), ("x2", "spoilt", {"raw_json": '{"n": 4'})]
    assert (out["b"].text, out["b"].tool_use, out["b"].stop_reason, out["b"].total_tokens) == ("part", [], None, None)


def test_any_success_status_is_read(spark):
    body = {"content": [{"type": "text", "text": "made"}], "stop_reason": "end_turn"}
    rows = [log_row(str(code), A, body, status=code) for code in (200, 201, 299, 300, 199, None)]
    out = {r.call_id: r.error for r in calllog.normalize_responses(spark.createDataFrame(rows, LOG)).collect()}
    assert {k for k, e in out.items() if e is None} == {"200", "201", "299"}


def test_failure_classes(spark):
    rows = [
        (1, 200, None, None), (2, 401, None, None), (3, 400, None, None), (4, 403, None, None), (5, 429, "7", None), (6, 429, "7.5", None),
        (7, 429, None, None), (8, 500, None, None), (9, 504, None, None), (10, None, None, "timeout"), (11, None, None, "reset"),
        (12, 422, "9", None), (13, 204, None, None), (14, 302, None, None),
    ]
    log = spark.createDataFrame(rows, "i int, http_status int, retry_after string, error_kind string")
    classified = calllog.classify_calls(log.withColumn("provider", F.lit("x")))
    out = {r.i: (r.failure_class, r.retryable, r.retry_after_s) for r in classified.collect()}
    assert out[1][0] == out[13][0] == "ok" and out[2] == ("authentication", False, None)
    assert out[3][:2] == out[4][:2] == ("refused", False)
    assert out[5] == ("rate_limited", True, 7.0) and out[6] == out[7] == ("rate_limited", True, None)
    assert out[8][:2] == out[9][:2] == ("unavailable", True)
    assert out[10][:2] == ("timeout", True) and out[11][:2] == ("transport_error", True)
    assert out[12] == ("unexpected_status", False, None) and out[14][0] == "unexpected_status"
    summary = {r.failure_class: (r.n_calls, r.n_with_wait) for r in calllog.failure_summary(classified).collect()}
    assert summary["rate_limited"] == (3, 1) and summary["unavailable"] == (2, 0)


@pytest.mark.parametrize("chunk_rows", [1, 1000])
def test_requests(spark, chunk_rows):
    rows = [
        (1, 1, "user", 'Say "hi"\n', None, None), (1, 0, "system", "Be brief", None, None), (1, 2, "assistant", "é", None, None),
        (1, 3, "tool", "42", "meter", "c1"), (1, 4, "narrator", None, "", None), (2, 0, "system", "only", None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string, tool_call_id string")
    tool = calllog.Tool("t", "d", {"type": "object"})
    options = calllog.RequestOptions("m", system="S", tools=(tool,))
    out = {r.conv_id: r for r in calllog.build_requests(df, options, A, chunk_rows).collect()}
    body = json.loads(out[1].payload)
    assert body == {
        "model": "m", "max_tokens": 4096, "temperature": 0.0, "stream": False, "system": "S",
        "messages": [{"role": "user", "content": 'Say "hi"\n'}, {"role": "assistant", "content": "é"},
                     {"role": "user", "content": "42"}, {"role": "assistant", "content": None}],
        "tools": [{"name": "t", "description": "d", "input_schema": {"type": "object"}}],
    }
    assert (out[1].n_messages, out[1].n_dropped_system) == (4, 1)
    assert json.loads(out[2].payload)["messages"] == [] and out[2].n_dropped_system == 1

    streaming = calllog.RequestOptions("m", system="S", tools=(tool,), stream=True)
    out = {r.conv_id: r for r in calllog.build_requests(df, streaming, B, chunk_rows).collect()}
    body = json.loads(out[1].payload)
    assert body["messages"][0] == {"role": "system", "content": "S"} and body["messages"][1]["content"] == "Be brief"
    assert body["messages"][4] == {"role": "tool", "content": "42", "name": "meter", "tool_call_id": "c1"}
    assert "name" not in body["messages"][5]
    assert body["tools"] == [{"type": "function", "function": {"name": "t", "description": "d", "parameters": {"type": "object"}}}]
    assert body["tool_choice"] == "auto" and body["stream_options"] == {"include_usage": True}
    assert out[1].n_messages == 6 and len(json.loads(out[2].payload)["messages"]) == 2
    bare = calllog.build_requests(df.drop("name", "tool_call_id"), calllog.RequestOptions("m"), B).collect()
    assert set(json.loads(bare[0].payload)) == {"model", "messages", "max_tokens", "temperature", "stream"}
    with pytest.raises(ValueError):
        calllog.build_requests(df, options, "nobody")
