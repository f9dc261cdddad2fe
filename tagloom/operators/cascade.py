"""The cascade that fills a register: ranked search strategies, prompts, an extractor, and the most trusted valid answer."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import shuffle_width

# --- fixed values ---------------------------------------------------------------------------------
NO_ANSWERS = ["N/A", "none", "no", "нет", "n/a", "{}", "json", "JSON", "JSON:", '{"value": NOANS, "uom": NOANS}', "NOANS"]
BATCH, BATCH_MARGIN, REJECT = 10_000, 500, 100_000
CONFIDENCE = {"table_en": 0.85, "table_ru": 0.80, "simple_en": 0.60, "simple_ru": 0.50, "tokens_en": 0.30, "tokens_ru": 0.25, "tech_specs": 0.05}
VALUES_LIMIT = 2048
# --------------------------------------------------------------------------------------------------


def is_valid(value: Column, possible: Column | None = None) -> Column:
    """True for an answer that is one: not null, no sign for no answer, and, if there is a list, an item of it."""
    ok = value.isNotNull() & ~value.isin(NO_ANSWERS) & ~value.startswith("NOANS") & ~value.endswith("NOANS") & ~value.startswith("```")
    ok = F.coalesce(ok, F.lit(False))
    return ok if possible is None else ok & (possible.isNull() | F.coalesce(F.array_contains(possible, value), F.lit(False)))


def batches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, batch_no, start, chars): what parts of a context are asked one after the other; none of a context over the limit."""
    n = F.length(text)
    starts = F.when(n < BATCH, F.array(F.lit(0))).when(n <= REJECT, F.sequence(F.lit(0), n - 1 - BATCH_MARGIN, F.lit(BATCH)))
    cut = df.select(key, n.alias("n"), F.posexplode(starts).alias("batch_no", "start"))
    chars = F.when(F.col("n") < BATCH, F.col("n")).otherwise(F.least(F.col("start") + BATCH + 2 * BATCH_MARGIN, F.col("n")) - F.col("start"))
    return cut.select(key, "batch_no", "start", chars.alias("chars"))


def parse_reply(reply: Column) -> Column:
    """struct<value, uom> of a reply, fenced or not; NOANS in both where it is no JSON with them."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(reply, "[\\r\\n]+", ""), "^\\s*```(?:json)?", ""), "```\\s*$", "")
    got = F.from_json(bare, "value string, uom string")
    bad = got.isNull() | got["value"].isNull()
    return F.struct(F.when(bad, "NOANS").otherwise(got["value"]).alias("value"), F.when(bad | got["uom"].isNull(), "NOANS").otherwise(got["uom"]).alias("uom"))


def prompt(name: Column, context: Column, values: Column, hint: Column, units: Column | None = None, kind: Column | None = None, mentioned: Column | None = None) -> Column:
    """What the extractor is asked: the object's kind, the property under the name that was searched, its allowed values and units, a hint, the context.

    Where mentioned is true only a yes or no is asked for, without values and units. Nulls leave their line out.
    """
    none = F.lit(None).cast("string")
    only = F.coalesce(mentioned, F.lit(False)) if mentioned is not None else F.lit(False)
    units, kind = (none if c is None else c for c in (units, kind))
    squeezed = F.regexp_replace(context, "\\s+", " ")
    return F.concat_ws(
        "\n", F.when(F.length(kind) > 0, F.concat(F.lit("Object: "), kind)), F.when(only, F.concat(F.lit("Is it mentioned, yes or no: "), name)).otherwise(F.concat(F.lit("Property: "), name)),
        F.when(values.isNotNull() & ~only, F.concat(F.lit("One of: "), F.substring(values, 1, VALUES_LIMIT))), F.when(units.isNotNull() & ~only, F.concat(F.lit("Unit, one of: "), units)), F.when(F.length(hint) > 0, hint), F.concat(F.lit("Text: "), squeezed),
    )


def reply_of(reply: str | None, possible: list[str] | None, mentioned: bool) -> tuple[str, str] | None:
    """(value, unit) of a valid reply to one prompt, else null: what parse_reply and is_valid say of it; a yes where only a mention was asked for."""
    text = re.sub(r"[\r\n]+", "", reply or "")
    if mentioned:
        return ("yes", "") if text.strip().lower().startswith(("y", "д")) else None
    try:
        got = json.loads(re.sub(r"```\s*$", "", re.sub(r"^\s*```(?:json)?", "", text)))
    except ValueError:
        return None
    if not isinstance(got, dict) or got.get("value") is None:
        return None
    value = got["value"] if isinstance(got["value"], str) else json.dumps(got["value"])
    unit = "NOANS" if got.get("uom") is None else str(got["uom"])
    bad = value in NO_ANSWERS or value.startswith(("NOANS", "```")) or value.endswith("NOANS")
    return None if bad or (possible is not None and len(possible) and value not in possible) else (value, unit)


class Extractor(Protocol):
    """Answers prompts with JSON texts of value and uom."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class RuleExtractor:
    """The offline extractor: the first number behind the property's name in the text, with the unit behind it."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            name = re.search(r"^(?:Property|Is it mentioned, yes or no): (.*)$", p, re.MULTILINE)
            text = re.sub(r"<[^<>]+>", " ", p[p.find("Text: ") + 6 :])
            if name and name[0].startswith("Is it"):
                out.append("yes" if name[1].lower() in text.lower() else "no")
                continue
            at = text.lower().find(name[1].lower()) if name else -1
            m = re.search(r"(-?\d+(?:[.,]\d+)?)\s*([^\s\d.,;:]\S{0,7})?", text[at + len(name[1]) :][:60]) if name and at >= 0 else None
            out.append(json.dumps({"value": m[1], "uom": (m[2] or "").rstrip(".,;")}, ensure_ascii=False) if m else "NOANS")
        return out


@dataclass
class HttpExtractor:
    """Asks a model behind an HTTP address that takes and gives JSON; an error is no answer."""

    url: str
    model: str
    seed: int = 420
    timeout: float = 120.0

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._ask(p) for p in prompts]

    def _ask(self, text: str) -> str:
        body = {"model": self.model, "prompt": text, "stream": False, "format": "json", "options": {"temperature": 0, "seed": self.seed}}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.loads(r.read()).get("response", "NOANS")
        except (OSError, ValueError):
            return "NOANS"


def extract(df: DataFrame, extractor: Extractor) -> DataFrame:
    """df, which has a column prompt, with the column reply; runs in Arrow batches on the executors."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            b["reply"] = extractor([p or "" for p in b["prompt"]]) if len(b) else pd.Series(dtype=object)
            yield b

    return df.mapInPandas(run, schema)


def best_answers(candidates: DataFrame) -> DataFrame:
    """(row_id, value, uom, strategy, confidence): for each task the first valid answer by falling confidence, ties by the strategy's name."""
    valid = candidates.filter(is_valid(F.col("value"), F.col("possible")))
    best = valid.groupBy("row_id").agg(F.max_by(F.struct("value", "uom", "strategy", "confidence"), F.struct("confidence", "strategy")).alias("b"))
    return best.select("row_id", "b.*")


ASKED = "row_id long, strategy string, confidence double, step int, prompt string, reply string, value string, uom string, valid boolean"


def attempts(tasks: DataFrame, strategies: list[tuple[str, float, DataFrame]], extractor: Extractor) -> DataFrame:
    """Every prompt that was sent, with its reply: (row_id, strategy, confidence, step, prompt, reply, value, uom, valid).

    tasks has row_id, name, values, hint, possible and may have units, kind and mentioned (only_if_mentioned);
    each strategy gives (row_id, context) and may give stage, by which the contexts of a task are asked before
    confidence counts, ord, by which those of one strategy are, and name, under which they are. The contexts of one
    task, of all strategies, are sorted into their order and asked one by one until a reply is valid, so no prompt is
    sent twice and none after the answer; a context over BATCH is asked in parts. They stream through sorted
    partitions, so a task may have any number of them. Nothing is asked of a null context. Send what comes out to a checkpoint before
    using it twice: it holds a model's answers.
    """
    parts = None
    for name, confidence, contexts in strategies:
        has = lambda c, other, own=contexts: F.col(c) if c in own.columns else other
        own = contexts.filter("context is not null").select(
            "row_id", "context", has("stage", F.lit(1)).cast("int").alias("stage"), has("name", F.lit(None).cast("string")).alias("searched"), has("ord", F.lit(0)).cast("long").alias("ord"), F.lit(name).alias("strategy"), F.lit(float(confidence)).alias("confidence")
        )
        parts = own if parts is None else parts.unionByName(own)
    once = parts.groupBy("row_id", "strategy", "context").agg(F.min(F.struct("stage", "ord", "searched", "confidence")).alias("c"))
    has = lambda c, kind: F.col(c) if c in tasks.columns else F.lit(None).cast(kind)
    asked = tasks.select("row_id", "name", "values", "hint", "possible", has("units", "string").alias("units"), has("kind", "string").alias("kind"), F.coalesce(has("mentioned", "boolean"), F.lit(False)).alias("mentioned")).join(once, "row_id")
    bounds = F.when(F.length("context") < BATCH, F.array(F.lit(0))).when(F.length("context") <= REJECT, F.sequence(F.lit(0), F.length("context") - 1 - BATCH_MARGIN, F.lit(BATCH)))
    width = F.when(F.length("context") < BATCH, F.lit(BATCH)).otherwise(F.lit(BATCH + 2 * BATCH_MARGIN))
    cut = asked.select("*", F.posexplode(bounds).alias("batch", "start"))
    text = prompt(F.coalesce("c.searched", "name"), F.substr(F.col("context"), F.col("start") + 1, width), F.col("values"), F.col("hint"), F.col("units"), F.col("kind"), F.col("mentioned"))
    order = ["row_id", "stage", "falling", "strategy", "ord", "prompt", "batch"]
    each = cut.select("row_id", "possible", "mentioned", F.col("c.stage").alias("stage"), (-F.col("c.confidence")).alias("falling"), "strategy", F.col("c.ord").alias("ord"), "batch", F.col("c.confidence").alias("confidence"), text.alias("prompt"))
    ranked = each.repartition(shuffle_width(tasks.sparkSession), "row_id").sortWithinPartitions(*order)

    def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done, asked_before = None, False, 0  # the task that a batch ended with
        for b in batches_:
            groups: list[list] = []  # row_id, possible, mentioned, its prompts, how many were asked before
            for k, possible, mentioned, name, confidence, p in zip(b["row_id"], b["possible"], b["mentioned"], b["strategy"], b["confidence"], b["prompt"], strict=True):
                if not groups or groups[-1][0] != k:
                    groups.append([k, None if possible is None else list(possible), bool(mentioned), [], asked_before if k == last else 0])
                groups[-1][3].append((name, confidence, p))
            rows: list[tuple] = []
            solved = {last} if done else set()
            open_, step = [g for g in groups if g[0] not in solved], 0
            while open_:
                for g, reply in zip(open_, extractor([g[3][step][2] for g in open_]), strict=True):
                    got = reply_of(reply, g[1], g[2])
                    name, confidence, p = g[3][step]
                    rows.append((g[0], name, confidence, g[4] + step, p, reply, *(got or (None, None)), got is not None))
                    if got is not None:
                        solved.add(g[0])
                step += 1
                open_ = [g for g in open_ if g[0] not in solved and step < len(g[3])]
            if groups:
                last, done, asked_before = groups[-1][0], groups[-1][0] in solved, groups[-1][4] + len(groups[-1][3])
            yield pd.DataFrame(rows, columns=["row_id", "strategy", "confidence", "step", "prompt", "reply", "value", "uom", "valid"])

    return ranked.mapInPandas(run, ASKED)


def solve(tasks: DataFrame, strategies: list[tuple[str, float, DataFrame]], extractor: Extractor) -> DataFrame:
    """(row_id, value, uom, strategy, confidence): the first valid answer of each task; takes what attempts takes, and asks no more than it."""
    return attempts(tasks, strategies, extractor).filter("valid").select("row_id", "value", "uom", "strategy", "confidence")


def summary(tasks: DataFrame, tried: DataFrame) -> DataFrame:
    """(tasks, solved, failed, prompts): the counters of a run over tasks (row_id) from its attempts; a task of which nothing was asked has failed."""
    by = tried.groupBy("row_id").agg(F.max(F.col("valid").cast("int")).alias("ok"), F.count("*").alias("n"))
    all_ = tasks.select("row_id").distinct().join(by, "row_id", "left").select(F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("n", F.lit(0)).alias("n"))
    return all_.agg(F.count("*").alias("tasks"), F.coalesce(F.sum("ok"), F.lit(0)).alias("solved"), F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("prompts"))


def fill(register: DataFrame, answers: DataFrame) -> DataFrame:
    """The register with the answers written into value and unit; rows without one keep theirs."""
    a = answers.select("row_id", F.col("value").alias("__v"), F.col("uom").alias("__u"))
    return register.join(a, "row_id", "left").withColumn("property_value", F.coalesce("__v", "property_value")).withColumn("uom", F.coalesce("__u", "uom")).drop("__v", "__u")
