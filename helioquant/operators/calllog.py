"""Recorded model calls as tables: normalised responses, streams, failures, usage, requests.

Nothing here calls a model. Input is what a client has logged: response bodies or stream lines.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioquant.functions.joins import null_safe_join
from helioquant.functions.numeric import count_where, mean, ratio
from helioquant.functions.sequence import CHUNK_ROWS, chunk_of, ordered_text

# Vendor names as they stand in the ``provider`` column.
MESSAGES_VENDOR = "anthropic"
COMPLETIONS_VENDOR = "openai_compatible"

# Stop reasons the first vendor uses, which are also the normalised ones.
STOP_REASONS = ("end_turn", "tool_use", "max_tokens", "stop_sequence")
# Finish reasons of the second vendor and what they become.
FINISH_REASONS = {
    "stop": "end_turn",
    "tool_calls": "tool_use",
    "function_call": "tool_use",
    "length": "max_tokens",
}
UNKNOWN = "unknown"

# Failure class and whether a retry can help, by HTTP status.
STATUS_CLASSES = {
    401: ("authentication", False),
    400: ("refused", False),
    403: ("refused", False),
    429: ("rate_limited", True),
    500: ("unavailable", True),
    502: ("unavailable", True),
    503: ("unavailable", True),
    504: ("unavailable", True),
}
TIMEOUT_CLASS = ("timeout", True)
TRANSPORT_CLASS = ("transport_error", True)
OTHER_CLASS = ("unexpected_status", False)
OK_CLASS = "ok"


def _get(source: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(source, path, kind)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _wrapped(key: str, text: Column) -> Column:
    """An object variant that keeps a text which is not valid JSON."""
    return F.parse_json(F.to_json(F.struct(text.alias(key))))


def _parsed_arguments(text: Column, raw_key: str) -> Column:
    """Argument text as a variant: absent or empty is ``{}``, unreadable text is kept raw."""
    parsed = F.try_parse_json(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.parse_json(F.lit("{}")))
        .when(parsed.isNotNull(), parsed)
        .otherwise(_wrapped(raw_key, text))
    )


def messages_stop_reason(raw: Column) -> Column:
    return F.when(raw.isin(*STOP_REASONS), raw).otherwise(F.lit(UNKNOWN))


def completions_stop_reason(raw: Column) -> Column:
    """A missing finish reason counts as an ordinary end."""
    out = F.when(raw.isNull(), F.lit("end_turn"))
    for finish, reason in FINISH_REASONS.items():
        out = out.when(raw == finish, F.lit(reason))
    return out.otherwise(F.lit(UNKNOWN))


def _response_of_messages(body: Column) -> dict[str, Column]:
    blocks = F.coalesce(_get(body, "$.content", "array<variant>"), F.array())

    def of_type(kind: str) -> Column:
        return F.filter(blocks, lambda b: _get(b, "$.type", "string") == kind)

    def tool(block: Column) -> Column:
        return F.struct(
            F.coalesce(_get(block, "$.id", "string"), F.lit("")).alias("id"),
            F.coalesce(_get(block, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(_get(block, "$.input", "variant"), F.parse_json(F.lit("{}"))).alias(
                "arguments"
            ),
        )

    return {
        "text_blocks": F.transform(
            of_type("text"), lambda b: F.coalesce(_get(b, "$.text", "string"), F.lit(""))
        ),
        "tool_use": F.transform(of_type("tool_use"), tool),
        "stop_reason": messages_stop_reason(_get(body, "$.stop_reason", "string")),
        "input_tokens": _get(body, "$.usage.input_tokens", "bigint"),
        "output_tokens": _get(body, "$.usage.output_tokens", "bigint"),
    }


def _response_of_completions(body: Column) -> dict[str, Column]:
    text = _get(body, "$.choices[0].message.content", "string")
    calls = F.coalesce(
        _get(body, "$.choices[0].message.tool_calls", "array<variant>"), F.array()
    )

    def tool(call: Column, index: Column) -> Column:
        raw = _get(call, "$.function.arguments", "variant")
        return F.struct(
            F.coalesce(
                _get(call, "$.id", "string"), F.concat(F.lit("call_"), index.cast("string"))
            ).alias("id"),
            F.coalesce(_get(call, "$.function.name", "string"), F.lit("")).alias("name"),
            F.when(_is_object(raw), raw)
            .otherwise(
                _parsed_arguments(_get(call, "$.function.arguments", "string"), "raw_arguments")
            )
            .alias("arguments"),
        )

    return {
        "text_blocks": F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(
            F.array().cast("array<string>")
        ),
        "tool_use": F.transform(calls, tool),
        "stop_reason": completions_stop_reason(_get(body, "$.choices[0].finish_reason", "string")),
        "input_tokens": _get(body, "$.usage.prompt_tokens", "bigint"),
        "output_tokens": _get(body, "$.usage.completion_tokens", "bigint"),
    }


def normalize_responses(log: DataFrame, default_model: str = "") -> DataFrame:
    """Response bodies of both vendors as one record; a row-local job without a shuffle.

    ``log``: call_id, provider, http_status, body, latency_ms. Rows that hold no usable response
    get an ``error`` and no blocks.
    """
    parsed = log.withColumn("_json", F.try_parse_json("body"))
    body = F.col("_json")
    messages, completions = _response_of_messages(body), _response_of_completions(body)
    first = F.col("provider") == MESSAGES_VENDOR
    choices = F.coalesce(F.size(_get(body, "$.choices", "array<variant>")), F.lit(0))
    error = (
        F.when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), F.lit("No successful response"))
        .when(body.isNull(), F.lit("Malformed JSON response"))
        .when(~first & (choices <= 0), F.lit("No completion choices returned"))
    )
    usable = error.isNull()

    def field_of(name: str) -> Column:
        return F.when(first, messages[name]).otherwise(completions[name])

    tokens_in = F.coalesce(field_of("input_tokens"), F.lit(0))
    tokens_out = F.coalesce(field_of("output_tokens"), F.lit(0))
    kept = [c for c in log.columns if c not in ("body", "latency_ms")]
    return parsed.select(
        *kept,
        F.coalesce(_get(body, "$.model", "string"), F.lit(default_model)).alias("model"),
        F.when(usable, F.array_join(field_of("text_blocks"), "")).alias("text"),
        F.when(usable, field_of("text_blocks")).alias("text_blocks"),
        F.when(usable, field_of("tool_use")).alias("tool_use"),
        F.when(usable, field_of("stop_reason")).alias("stop_reason"),
        F.when(usable, tokens_in).alias("input_tokens"),
        F.when(usable, tokens_out).alias("output_tokens"),
        F.when(usable, tokens_in + tokens_out).alias("total_tokens"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        error.alias("error"),
    )


def _stream_fields(lines: DataFrame) -> DataFrame:
    """What each recorded line contributes: text, a tool event, a stop reason, token counts.

    Row-local: lines are parsed once, where they lie. The end marker survives as ``_done``.
    """
    payload = F.trim(F.expr("substring(line, 7)"))
    data = lines.where(F.col("line").startswith("data: ")).select(
        "call_id", "provider", "seq", payload.alias("_payload")
    )
    parsed = data.withColumn("_event", F.try_parse_json("_payload")).withColumn(
        "_done", F.col("_payload") == "[DONE]"
    )
    event = F.col("_event")
    first = F.col("provider") == MESSAGES_VENDOR
    kind = _get(event, "$.type", "string")
    delta_kind = _get(event, "$.delta.type", "string")
    finish = F.nullif(_get(event, "$.choices[0].finish_reason", "string"), F.lit(""))
    reported = _get(event, "$.usage", "variant")
    usage_b = ~first & _is_object(reported) & (F.schema_of_variant(reported) != "OBJECT<>")
    raw_stop = _get(event, "$.delta.stop_reason", "string")
    starts = (kind == "content_block_start") & (
        _get(event, "$.content_block.type", "string") == "tool_use"
    )

    def tool_event(name: str, index=None, call_id=None, label=None, piece=None) -> Column:
        text = F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("kind"),
            (F.lit(0).cast("bigint") if index is None else index).alias("index"),
            F.nullif(text if call_id is None else call_id, F.lit("")).alias("id"),
            F.nullif(text if label is None else label, F.lit("")).alias("name"),
            (text if piece is None else piece).alias("piece"),
        )

    nothing = F.array().cast(
        "array<struct<kind:string,index:bigint,id:string,name:string,piece:string>>"
    )
    events_a = (
        F.when(
            starts,
            F.array(
                tool_event(
                    "start",
                    call_id=_get(event, "$.content_block.id", "string"),
                    label=_get(event, "$.content_block.name", "string"),
                )
            ),
        )
        .when(kind == "content_block_stop", F.array(tool_event("stop")))
        .when(
            (kind == "content_block_delta") & (delta_kind == "input_json_delta"),
            F.array(tool_event("piece", piece=_get(event, "$.delta.partial_json", "string"))),
        )
        .otherwise(nothing)
    )
    calls = F.coalesce(_get(event, "$.choices[0].delta.tool_calls", "array<variant>"), F.array())
    pieces_b = F.transform(
        calls,
        lambda c: tool_event(
            "piece",
            F.coalesce(_get(c, "$.index", "bigint"), F.lit(0)),
            _get(c, "$.id", "string"),
            _get(c, "$.function.name", "string"),
            _get(c, "$.function.arguments", "string"),
        ),
    )
    events_b = F.concat(
        pieces_b, F.when(finish.isNotNull(), F.array(tool_event("stop"))).otherwise(nothing)
    )
    return parsed.where(F.col("_done") | event.isNotNull()).select(
        "call_id",
        "provider",
        "seq",
        "_done",
        F.when(
            first,
            F.when(
                (kind == "content_block_delta") & (delta_kind == "text_delta"),
                _get(event, "$.delta.text", "string"),
            ),
        )
        .otherwise(_get(event, "$.choices[0].delta.content", "string"))
        .alias("text"),
        F.when(first, events_a).otherwise(events_b).alias("tools"),
        F.when(first, F.when((kind == "message_delta") & raw_stop.isin(*STOP_REASONS), raw_stop))
        .otherwise(F.when(finish.isNotNull(), completions_stop_reason(finish)))
        .alias("stop"),
        F.when(
            first & (kind == "message_start"),
            F.coalesce(_get(event, "$.message.usage.input_tokens", "bigint"), F.lit(0)),
        )
        .when(usage_b, F.coalesce(_get(event, "$.usage.prompt_tokens", "bigint"), F.lit(0)))
        .alias("tokens_in"),
        F.when(
            first & (kind == "message_delta"),
            F.coalesce(_get(event, "$.usage.output_tokens", "bigint"), F.lit(0)),
        )
        .when(usage_b, F.coalesce(_get(event, "$.usage.completion_tokens", "bigint"), F.lit(0)))
        .alias("tokens_out"),
    )


def _last_known(items: Column, name: str) -> Column:
    """The last non-null field of an ordered array of records."""
    return F.get(F.reverse(F.filter(items, lambda e: e[name].isNotNull())), F.lit(0))[name]


def _gather(items: Column) -> list[Column]:
    """Fields of the ordered records of a chunk or a call, up to the end marker."""
    done = F.array_position(F.transform(items, lambda e: e["_done"]), True)
    kept = F.when(done > 0, F.slice(items, F.lit(1), done.cast("int"))).otherwise(items)
    return [
        F.exists(items, lambda e: e["_done"]).alias("_done"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
        F.flatten(F.transform(kept, lambda e: e["tools"])).alias("tools"),
        _last_known(kept, "stop").alias("stop"),
        _last_known(kept, "tokens_in").alias("tokens_in"),
        _last_known(kept, "tokens_out").alias("tokens_out"),
    ]


PARTS = ("_done", "text", "tools", "stop", "tokens_in", "tokens_out")


def _positions(events: Column, kind: str) -> Column:
    """1-based positions of the events of a kind."""
    marked = F.transform(
        events, lambda e, i: F.when(e["kind"] == kind, i + F.lit(1)).cast("int")
    )
    return F.filter(marked, lambda i: i.isNotNull())


def _between(events: Column, start: Column, end: Column) -> Column:
    """Events at positions ``start`` up to, not including, ``end``."""
    return F.slice(events, start, F.greatest(end - start, F.lit(0)))


def _joined(events: Column) -> Column:
    return F.array_join(F.transform(events, lambda e: e["piece"]), "")


def _event(like: Column, kind: str, **fields: Column) -> Column:
    """A tool event typed as ``like``; fields that are not named are null."""
    names = ("index", "id", "name", "piece")
    return F.struct(
        F.lit(kind).alias("kind"),
        *[F.coalesce(fields.get(n, F.lit(None)), F.nullif(like[n], like[n])).alias(n) for n in names],
    )


def _segments(events: Column, cuts: Column, shape) -> Column:
    """``shape(run, is_first, is_last)`` of the events from each cut position up to the next one, flattened."""
    after_last = (F.size(events) + F.lit(1)).cast("int")
    nexts = F.concat(F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))), F.array(after_last))

    def segment(begin: Column, end: Column) -> Column:
        return F.struct(
            _between(events, begin, end).alias("run"),
            (begin == 1).alias("is_first"),
            (end == after_last).alias("is_last"),
        )

    runs = F.zip_with(cuts, nexts, segment)
    return F.flatten(F.transform(runs, lambda r: shape(r["run"], r["is_first"], r["is_last"])))


def _messages_summary(events: Column) -> Column:
    """Fewest events of the first vendor that mean the same, whatever comes before or after.

    What precedes the first start belongs to a block opened earlier: its pieces become one, with the
    stop that ends them. Each block is its start, its joined pieces and its stop. A block that another
    one follows without a stop never closes and is left out; the last one may stay open. Summaries
    of runs, put together and summarised again, are the summary of the whole.
    """
    starts = _positions(events, "start")
    cuts = F.array_distinct(F.concat(F.array(F.lit(1)), starts))

    def block(run: Column, is_first: Column, is_last: Column) -> Column:
        first = F.get(run, F.lit(0))
        stop = F.array_position(F.transform(run, lambda e: e["kind"]), "stop").cast("int")
        opens = first["kind"] == "start"
        end = F.when(stop > 0, stop).otherwise(F.size(run) + F.lit(1))
        skip = F.when(opens, F.lit(2)).otherwise(F.lit(1))
        pieces = _between(run, skip, end)
        nothing = F.slice(run, F.lit(1), F.lit(0))
        kept = F.concat(
            F.when(opens, F.array(first)).otherwise(nothing),
            F.when(F.size(pieces) > 0, F.array(_event(first, "piece", piece=_joined(pieces)))).otherwise(nothing),
            F.when(stop > 0, F.slice(run, F.greatest(stop, F.lit(1)), F.lit(1))).otherwise(nothing),
        )
        lost = opens & (stop == 0) & ~is_last
        return F.when((F.size(run) == 0) | lost, nothing).otherwise(kept)

    return _segments(events, cuts, block)


def _completions_summary(events: Column) -> Column:
    """Fewest events of the second vendor that mean the same, whatever comes before or after.

    Between two stops one event an index is left, in the order of first pieces, with the last id and
    name and the joined arguments. Stops that end nothing are left out, but for the first, which
    may end what an earlier run has opened.
    """
    cuts = F.array_distinct(F.concat(F.array(F.lit(1)), F.transform(_positions(events, "stop"), lambda p: p + F.lit(1))))

    def turn(run: Column, is_first: Column, is_last: Column) -> Column:
        pieces = F.filter(run, lambda e: e["kind"] == "piece")

        def joined(index: Column) -> Column:
            own = F.filter(pieces, lambda e: e["index"] == index)
            return _event(
                F.get(own, F.lit(0)), "piece", index=index,
                id=_last_known(own, "id"), name=_last_known(own, "name"), piece=_joined(own),
            )

        stops = F.filter(run, lambda e: e["kind"] == "stop")
        kept = F.transform(F.array_distinct(F.transform(pieces, lambda e: e["index"])), joined)
        return F.when(~is_first & (F.size(pieces) == 0), F.slice(run, F.lit(1), F.lit(0))).otherwise(F.concat(kept, stops))

    return _segments(events, cuts, turn)


def _messages_tools(events: Column) -> Column:
    """Tool calls of the first vendor: each runs from its start to the next block stop."""
    starts = _positions(events, "start")
    after_last = F.size(events) + F.lit(1)
    nexts = F.concat(
        F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(after_last)
    )

    def tool(start: Column, following: Column) -> Column:
        run = _between(events, start, following)
        stop = F.array_position(F.transform(run, lambda e: e["kind"]), "stop").cast("int")
        head = F.get(run, F.lit(0))
        return F.struct(
            head["id"].alias("id"),
            head["name"].alias("name"),
            (stop > 0).alias("closed"),
            _joined(_between(run, F.lit(2), stop)).alias("args"),
        )

    # One start has one following position; without starts there is nothing to pair.
    pairs = F.when(F.size(starts) > 0, F.zip_with(starts, nexts, tool))
    return F.filter(
        F.coalesce(pairs, F.array().cast("array<struct<id:string,name:string,closed:boolean,args:string>>")),
        lambda t: t["closed"] & t["id"].isNotNull() & t["name"].isNotNull(),
    )


def _completions_tools(events: Column) -> Column:
    """Tool calls of the second vendor: the pieces of an index, once a finish reason arrived."""
    stops = _positions(events, "stop")
    begins = F.concat(
        F.array(F.lit(1)),
        F.transform(
            F.slice(stops, F.lit(1), F.greatest(F.size(stops) - 1, F.lit(0))),
            lambda p: p + F.lit(1),
        ),
    )

    def tools_of(begin: Column, end: Column) -> Column:
        run = _between(events, begin, end)

        def tool(index: Column) -> Column:
            own = F.filter(run, lambda e: e["index"] == index)
            return F.struct(
                F.coalesce(_last_known(own, "id"), F.lit("")).alias("id"),
                F.coalesce(_last_known(own, "name"), F.lit("")).alias("name"),
                F.lit(True).alias("closed"),
                _joined(own).alias("args"),
            )

        # Distinct indexes keep the order of their first piece.
        return F.transform(F.array_distinct(F.transform(run, lambda e: e["index"])), tool)

    rounds = F.when(F.size(stops) > 0, F.zip_with(begins, stops, tools_of))
    return F.flatten(
        F.coalesce(
            rounds,
            F.array().cast("array<array<struct<id:string,name:string,closed:boolean,args:string>>>"),
        )
    )


def stream_runs(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Summaries of runs of ``chunk_rows`` line numbers of each call, one row a run.

    ``lines``: call_id, provider, seq, line. A copy of a line (same call, same number) counts once;
    copies collapse before they are shuffled. A run keeps its joined text, its last known stop
    reason and token counts, and its tool events in the shortest form that can still be joined with
    the runs next to it: whole blocks, and what is open at its head and its tail.
    """
    keys = ["call_id", "provider"]
    fields = _stream_fields(lines).withColumn("_chunk", chunk_of("seq", chunk_rows))
    events = F.col("tools")
    return (
        fields.groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_set(F.struct("seq", *PARTS))).alias("_rows"))
        .select(*keys, "_chunk", *_gather(F.col("_rows")))
        .withColumn(
            "tools",
            F.when(F.size(events) < 2, events)
            .when(F.col("provider") == MESSAGES_VENDOR, _messages_summary(events))
            .otherwise(_completions_summary(events)),
        )
    )


def assemble_streams(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Recorded stream lines put together per call: text, tool calls, stop reason, usage.

    ``lines``: call_id, provider, seq, line. Lines are parsed once and summarised in runs
    (``stream_runs``), which bounds what a task collects. A call then joins its runs' summaries: a
    few events a tool call and run, that is, what the result row of the call holds in any case.
    """
    keys = ["call_id", "provider"]
    calls = (
        stream_runs(lines, chunk_rows)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_chunk", *PARTS))).alias("_rows"))
        .select(*keys, *_gather(F.col("_rows")))
    )

    def as_tool(raw_key: str):
        return lambda t: F.struct(
            t["id"].alias("id"),
            t["name"].alias("name"),
            _parsed_arguments(t["args"], raw_key).alias("arguments"),
        )

    first = F.col("provider") == MESSAGES_VENDOR
    events = F.col("tools")
    known = F.col("tokens_out").isNotNull()
    # Usage counts once the vendor has reported the output side.
    tokens_in = F.when(known, F.coalesce("tokens_in", F.lit(0).cast("bigint")))
    return calls.select(
        *keys,
        "text",
        F.when(first, F.transform(_messages_tools(events), as_tool("raw_json")))
        .otherwise(F.transform(_completions_tools(events), as_tool("raw_arguments")))
        .alias("tool_use"),
        F.col("stop").alias("stop_reason"),
        tokens_in.alias("input_tokens"),
        F.col("tokens_out").alias("output_tokens"),
        (tokens_in + F.col("tokens_out")).alias("total_tokens"),
    )


def classify_calls(
    log: DataFrame, status: str = "http_status", error_kind: str = "error_kind"
) -> DataFrame:
    """Failure class, whether a retry can help, and the wait the server asked for.

    Rows without a status are timeouts where ``error_kind`` says so, else transport errors. Only
    a whole number of seconds counts as a ``retry_after``.
    """
    code = F.col(status)
    name = F.when(
        code.isNull() & (F.coalesce(F.col(error_kind), F.lit("")) == "timeout"),
        F.lit(TIMEOUT_CLASS[0]),
    ).when(code.isNull(), F.lit(TRANSPORT_CLASS[0]))
    retry = F.when(code.isNull(), F.lit(True))
    for value, (label, retryable) in STATUS_CLASSES.items():
        name = name.when(code == value, F.lit(label))
        retry = retry.when(code == value, F.lit(retryable))
    fine = code.between(200, 299)
    name = name.when(fine, F.lit(OK_CLASS)).otherwise(F.lit(OTHER_CLASS[0]))
    retry = retry.otherwise(F.lit(OTHER_CLASS[1]))
    wait = F.when(
        (code == 429) & F.col("retry_after").rlike(r"^[0-9]+$"), F.col("retry_after").cast("double")
    )
    return log.withColumns(
        {"failure_class": name, "retryable": retry, "retry_after_s": wait}
    )


def failure_summary(classified: DataFrame, by: Sequence[str] = ("provider",)) -> DataFrame:
    return classified.groupBy(*by, "failure_class", "retryable").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count("retry_after_s").alias("n_with_wait")
    )


def usage_rollup(
    normalized: DataFrame,
    by: str = "model",
    all_label: str | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Calls, tokens and latency per model over the usable responses.

    With ``all_label`` a row over all models is added by grouping sets: its mean is the quotient of
    the sums and its median is exact. Medians count whole milliseconds first and then only the
    values of those that hold the middle ranks, so that no group's values meet in one task.
    Responses without a model have a row of their own, with a null model.
    """
    used = normalized.where(F.col("error").isNull()).withColumn("_ms", F.floor("latency_ms"))
    sets = [[by]] if all_label is None else [[by], []]

    def grouped(*more: str):
        return used.groupingSets([[*s, *more] for s in sets], by, *more)

    whole = (F.grouping(by) == 1).alias("_all")
    totals = grouped().agg(
        whole,
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        mean("latency_ms", decimals).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    label = [by, "_all"]
    # One row a label and millisecond: bounded by the longest latency, whatever the number of calls.
    spans = grouped("_ms").agg(whole, F.count("latency_ms").alias("_n")).where(F.col("_n") > 0)
    ranks = Window.partitionBy(*label).orderBy("_ms").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*label)
    spans = spans.withColumns({"_end": F.sum("_n").over(ranks), "_size": F.sum("_n").over(everything)})
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    start = F.col("_end") - F.col("_n")
    holds = ((start <= low) & (low < F.col("_end"))) | ((start <= high) & (high < F.col("_end")))
    middle = spans.where(holds).select(*label, "_ms", start.alias("_start"), low.alias("_low"), high.alias("_high"))
    counted = grouped("_ms", "latency_ms").agg(whole, F.count(F.lit(1)).alias("_n"))
    inside = null_safe_join(counted, middle, [*label, "_ms"], "inner")
    order = Window.partitionBy(*label, "_ms").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_start") + F.sum("_n").over(order))

    def at(rank: str):
        hit = (F.col("_end") - F.col("_n") <= F.col(rank)) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(hit, F.col("latency_ms")))

    medians = inside.groupBy(*label).agg(((at("_low") + at("_high")) / 2).alias("median_latency_ms"))
    return null_safe_join(totals, medians, label, "left").select(
        F.when(F.col("_all"), F.lit(all_label)).otherwise(F.col(by)).alias(by),
        "calls", "input_tokens", "output_tokens", "total_tokens",
        "avg_latency_ms", "median_latency_ms", "max_latency_ms",
    )


CHECKS = (
    "tool_present",
    "tool_name",
    "tool_id",
    "arguments_valid",
    "stop_reason",
    "tokens_positive",
    "latency_positive",
    "one_usage_record",
)


def tool_call_checks(
    normalized: DataFrame, tool_name: str, required: Sequence[str] = ()
) -> DataFrame:
    """The invariants of a tool call, one boolean each, and the names of those that failed.

    Checks of the first tool block fail where there is no block. The usage records of a call are
    counted by one aggregate over the call ids.
    """
    records = (
        normalized.where(F.col("error").isNull())
        .groupBy("call_id")
        .agg(F.count(F.lit(1)).alias("n_usage_records"))
    )
    tool = F.get(F.col("tool_use"), F.lit(0))
    present = F.coalesce(F.size("tool_use") > 0, F.lit(False))
    arguments_ok = _is_object(tool["arguments"])
    for key in required:
        arguments_ok = arguments_ok & _get(tool["arguments"], f"$['{key}']", "variant").isNotNull()
    checks = {
        "tool_present": present,
        "tool_name": tool["name"] == tool_name,
        "tool_id": F.trim(tool["id"]) != "",
        "arguments_valid": arguments_ok,
        "stop_reason": F.col("stop_reason") == "tool_use",
        "tokens_positive": (F.col("input_tokens") > 0) & (F.col("output_tokens") > 0),
        "latency_positive": F.col("latency_ms") > 0,
        "one_usage_record": F.coalesce("n_usage_records", F.lit(0)) == 1,
    }
    joined = normalized.join(records, "call_id", "left")
    flagged = joined.select(
        "call_id",
        "provider",
        "model",
        *[F.coalesce(check, F.lit(False)).alias(f"ok_{name}") for name, check in checks.items()],
    )
    failed = F.array_compact(
        F.array(*[F.when(~F.col(f"ok_{name}"), F.lit(name)) for name in CHECKS])
    )
    return flagged.withColumn("failed_checks", failed)


def tool_reliability(checks: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of calls with a tool block, and of those the share with a right name, id, arguments."""
    present = F.col("ok_tool_present")
    right = present & F.col("ok_tool_name") & F.col("ok_tool_id") & F.col("ok_arguments_valid")
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        ratio(count_where(present), F.count(F.lit(1))).alias("trigger_rate"),
        ratio(count_where(right), count_where(present)).alias("argument_accuracy"),
    )


@dataclass(frozen=True)
class Tool:
    """A tool the model may call; ``parameters`` is a JSON schema."""

    name: str
    description: str
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RequestOptions:
    model: str
    system: str | None = None
    tools: tuple[Tool, ...] = ()
    max_tokens: int = 4096
    temperature: float = 0.0
    stream: bool = False


def _json_text(value: Column) -> Column:
    """A string column as a JSON literal (``null`` for null)."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))


def _request_tail(options: RequestOptions, vendor: str) -> str:
    """Everything of the payload after the messages: the same for all rows of the job."""
    tail: dict[str, Any] = {
        "max_tokens": options.max_tokens,
        "temperature": options.temperature,
        "stream": options.stream,
    }
    if vendor == MESSAGES_VENDOR:
        if options.system:
            tail["system"] = options.system
        if options.tools:
            tail["tools"] = [
                {"name": t.name, "description": t.description, "input_schema": t.parameters}
                for t in options.tools
            ]
    else:
        if options.tools:
            tail["tools"] = [
                {
                    "type": "function",
                    "function": {
                        "name": t.name, "description": t.description, "parameters": t.parameters,
                    },
                }
                for t in options.tools
            ]
            tail["tool_choice"] = "auto"
        if options.stream:
            tail["stream_options"] = {"include_usage": True}
    return json.dumps(tail, ensure_ascii=False)


def build_requests(
    conversations: DataFrame,
    options: RequestOptions,
    vendor: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One request payload (JSON text) per conversation, messages in turn order.

    ``conversations``: conv_id, turn, role, text, and optionally name and tool_call_id. The first
    vendor takes no system rows in its list: they are dropped and counted. Messages become JSON
    where the rows lie and are joined by chunks of turns, then by conversation.
    """
    if vendor not in (MESSAGES_VENDOR, COMPLETIONS_VENDOR):
        raise ValueError(f"unknown vendor {vendor!r}")
    role = F.col("role")
    if vendor == MESSAGES_VENDOR:
        dropped = role == "system"
        sent_role = F.when(role.isin("user", "tool"), F.lit("user")).otherwise(F.lit("assistant"))
        optional: list[str] = []
    else:
        dropped = F.lit(False)
        sent_role = role
        optional = [c for c in ("name", "tool_call_id") if c in conversations.columns]
    extras = [
        F.when(
            F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f', "{c}": '), _json_text(F.col(c)))
        )
        for c in optional
    ]
    message = F.concat(
        F.lit('{"role": '), _json_text(sent_role),
        F.lit(', "content": '), _json_text(F.col("text")),
        *[F.coalesce(e, F.lit("")) for e in extras], F.lit("}"),
    )
    rows = conversations.select(
        "conv_id",
        "turn",
        chunk_of("turn", chunk_rows).alias("_chunk"),
        F.when(~dropped, message).alias("_message"),
        F.when(~dropped, sent_role).alias("_role"),
        dropped.alias("_dropped"),
    )
    per_chunk = rows.groupBy("conv_id", "_chunk").agg(
        ordered_text("_message", "turn", ", ").alias("_part"),
        ordered_text("_role", "turn", ",").alias("_roles"),
        F.count("_message").alias("_n"),
        count_where(F.col("_dropped")).alias("_d"),
    )
    per_conv = per_chunk.groupBy("conv_id").agg(
        ordered_text("_part", "_chunk", ", ").alias("_messages"),
        F.coalesce(ordered_text("_roles", "_chunk", ","), F.lit("")).alias("roles"),
        F.sum("_n").alias("n_messages"),
        F.sum("_d").alias("n_dropped_system"),
    )
    lead = ""
    if vendor == COMPLETIONS_VENDOR and options.system:
        lead = json.dumps({"role": "system", "content": options.system}, ensure_ascii=False)
    body = F.concat_ws(", ", F.lit(lead or None), F.col("_messages"))
    return per_conv.select(
        "conv_id",
        (F.col("n_messages") + F.lit(1 if lead else 0)).alias("n_messages"),
        "n_dropped_system",
        "roles",
        F.concat(
            F.lit('{"model": ' + json.dumps(options.model, ensure_ascii=False) + ', "messages": ['),
            body,
            F.lit("], " + _request_tail(options, vendor)[1:]),
        ).alias("payload"),
    )
