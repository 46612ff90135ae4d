"""Asking models about candidates: consent, budget, triage, attempts, escalation, and the cache between.

A provider is a callable (tier, prompt, correction) -> Reply. It is given by
the caller; the default replays recorded turns, so nothing is ever sent
unless a caller brings a provider that does. Candidates are asked within their
partition (``mapInPandas``), each on its own: what a lost executor had asked
is asked again, or found in the cache table. The budget of a whole run is
decided before, by a fold over one number per candidate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import token_estimate
from ..operators import gate
from ..values import SEVERITIES

VERDICTS = ("confirmed", "rejected", "review_required")
OUTCOME = (
    "candidate_id string, tier string, answered boolean, reason string, verdict string, cwe string, rationale string, cited array<string>, attempts array<struct<tier:string,number:int,outcome:string,detail:string>>, "
    "calls long, input_tokens long, output_tokens long"
)


class Reply(NamedTuple):
    """What a provider returned: a text, or why there is none (transport: try again; refused: final)."""

    text: str | None = None
    failure: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0


Provider = Callable[[str, str, "str | None"], Reply]


@dataclass
class Attempts:
    """The asking of one candidate at one tier."""

    tier: str
    log: list[tuple[str, int, str, str]] = field(default_factory=list)
    calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0


def read_reply(text: str) -> tuple[dict | None, str]:
    """The answer of a text and "", or None and what is wrong with it: a correction to send along."""
    try:
        answer = json.loads(text)
    except ValueError as e:
        return None, f"not JSON: {e}"
    if not isinstance(answer, dict):
        return None, "not an object"
    if answer.get("verdict") not in VERDICTS:
        return None, "verdict is not one of " + ", ".join(VERDICTS)
    if not isinstance(answer.get("rationale"), str) or not answer["rationale"].strip():
        return None, "rationale is missing"
    cited = answer.get("cited", [])
    if not isinstance(cited, list) or not all(isinstance(c, str) for c in cited):
        return None, "cited is no list of ids"
    if answer["verdict"] == "confirmed" and not isinstance(answer.get("cwe"), str):
        return None, "a confirmed verdict names a weakness"
    return answer, ""


def call(provider: Provider, asked: Attempts, number: int, prompt: str, correction: str | None, transport_retries: int) -> Reply | None:
    """One reply; failures of transport are tried again, refusals are final. Every try is logged and counted."""
    for _ in range(transport_retries + 1):
        asked.calls += 1
        try:
            reply = provider(asked.tier, prompt, correction)
        except Exception as e:  # a provider that breaks is a failure of transport
            reply = Reply(failure=f"transport: {e}")
        asked.input_tokens += reply.input_tokens
        asked.output_tokens += reply.output_tokens
        if reply.text is not None:
            return reply
        final = not str(reply.failure).startswith("transport")
        asked.log.append((asked.tier, number, "refused" if final else "transport_error", str(reply.failure)))
        if final:
            return None
    return None


def attempt(provider: Provider, tier: str, prompt: str, issued: Sequence[str] | None, remembered: str | None = None, most: int = 3, transport_retries: int = 2) -> tuple[dict | None, Attempts]:
    """Ask until an answer is valid, the attempts run out, or a retry is pointless.

    A valid remembered answer is used as it is. An answer that breaks the
    schema is asked for again, with what was wrong; one that cites an id that
    was not issued ends the asking.
    """
    asked = Attempts(tier)
    if remembered is not None:
        answer, _ = read_reply(remembered)
        if answer is not None:
            asked.log.append((tier, 1, "cached", ""))
            return answer, asked
    correction = None
    for number in range(1, most + 1):
        reply = call(provider, asked, number, prompt, correction, transport_retries)
        if reply is None:
            return None, asked
        answer, correction = read_reply(reply.text or "")
        if answer is None:
            asked.log.append((tier, number, "schema_invalid", correction))
            continue
        unknown = sorted(set(answer.get("cited", [])) - set(issued)) if issued is not None else []
        if unknown:
            asked.log.append((tier, number, "citation_unknown", ", ".join(unknown)))
            return None, asked
        asked.log.append((tier, number, "accepted", ""))
        return answer, asked
    return None, asked


def reason_of(log: Sequence[tuple[str, int, str, str]]) -> str:
    """Why no answer came, from the last thing that went wrong."""
    last = log[-1][2] if log else "transport_error"
    return {"citation_unknown": "citation_unresolved", "transport_error": "provider_unavailable", "refused": "provider_unavailable"}.get(last, "schema_invalid_response")


def adjudicate_one(row: Mapping[str, object], provider: Provider, allow_escalation: bool, escalate_at: str, most: int) -> tuple:
    """The outcome row of one candidate: triage, the routed tier, and an escalation whose failure keeps the first answer."""
    asked: list[Attempts] = []

    def ask(tier: str, issued: Sequence[str] | None, remembered: object = None) -> dict | None:
        answer, done = attempt(provider, tier, str(row["prompt"]), issued, remembered if isinstance(remembered, str) else None, most)
        asked.append(done)
        return answer

    issued = [str(x) for x in (row["issued"] if row["issued"] is not None else [])]
    triage = ask("triage", None) if row["triage"] else None
    tier = "triage" if triage is not None and triage["verdict"] == "rejected" else "adjudication"
    answer = triage if tier == "triage" else ask("adjudication", issued, row["remembered"])
    severe = row["severity"] in SEVERITIES[: SEVERITIES.index(escalate_at) + 1]
    if tier == "adjudication" and answer is not None and answer["verdict"] == "review_required" and severe and allow_escalation and issued:
        higher = ask("escalation", issued)
        if higher is not None:
            tier, answer = "escalation", higher
    log = [x for a in asked for x in a.log]
    calls, spent, written = (sum(getattr(a, k) for a in asked) for k in ("calls", "input_tokens", "output_tokens"))
    if answer is None:
        return row["candidate_id"], tier, False, reason_of(log), None, None, None, [], log, calls, spent, written
    return row["candidate_id"], tier, True, None, answer["verdict"], answer.get("cwe"), answer["rationale"], list(answer.get("cited", [])), log, calls, spent, written


def adjudicate(
    candidates: DataFrame, provider: Provider, consent: bool, cache: DataFrame | None = None, model_id: str = "recorded", prompt_version: str = "1", schema_version: str = "1",
    allow_escalation: bool = True, escalate_at: str = "high", most: int = 3,
) -> DataFrame:
    """The outcome of every candidate (OUTCOME's columns), none left out.

    candidates: candidate_id, prompt (null: no context could be made),
    issued (ids it may cite), severity, triage (whether to ask the cheap tier
    first), starved (the run's budget ended before it). cache: key, text of
    accepted answers by content. Without consent nothing is asked and it raises.
    """
    if not consent:
        raise PermissionError("there is no consent to send code to a model")
    key = ids.cache_key(F.col("prompt"), F.lit(model_id), F.lit(prompt_version), F.lit(schema_version))
    keyed = candidates.withColumn("key", key)
    known = keyed.join(cache.select("key", F.col("text").alias("remembered")).dropDuplicates(["key"]), "key", "left") if cache is not None else keyed.withColumn("remembered", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUTCOME.replace("struct<tier:string,number:int,outcome:string,detail:string>", "x").split(", ")]
        for batch in batches:
            rows = [adjudicate_one(r, provider.anew() if isinstance(provider, Replay) else provider, allow_escalation, escalate_at, most) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=names).assign(attempts=lambda d: [[{"tier": t, "number": n, "outcome": o, "detail": x} for t, n, o, x in log] for log in d["attempts"]])

    asked = known.where("prompt is not null and not starved").select("candidate_id", "prompt", "issued", "severity", "triage", "remembered").mapInPandas(run, OUTCOME)
    refused = known.where("prompt is null or starved").select("candidate_id", F.when(F.col("prompt").isNull(), "context_budget_exceeded").otherwise("run_budget_exhausted").alias("reason"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in asked.schema.fields}
    empty |= {"tier": F.lit("adjudication"), "answered": F.lit(False), "cited": F.array().cast("array<string>"), "attempts": F.array().cast(asked.schema["attempts"].dataType), "calls": F.lit(0).cast("long"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long")}
    kept = refused.select(*[F.col(n) if n in ("candidate_id", "reason") else c.alias(n) for n, c in empty.items()])
    return asked.unionByName(kept)


class Replay:
    """A provider of recorded turns: those of a prompt's key and tier in order, then failures of transport.

    Each candidate hears them from the first, so an answer does not depend on
    which other candidates its task has.
    """

    def __init__(self, turns: Mapping[tuple[str, str], Sequence[Mapping[str, object]]]) -> None:
        self.turns, self.at = turns, {}

    def anew(self) -> Replay:
        return Replay(self.turns)

    def __call__(self, tier: str, prompt: str, correction: str | None) -> Reply:
        place = (prompt, tier)
        n = self.at[place] = self.at.get(place, -1) + 1
        recorded = self.turns.get(place, ())
        if n >= len(recorded):
            return Reply(failure="transport: nothing more is recorded")
        turn = recorded[n]
        return Reply(turn.get("text"), turn.get("failure"), int(turn.get("input_tokens", 0)), int(turn.get("output_tokens", 0)))


def naive_prompts(candidates: DataFrame, files: DataFrame, lines: int = 40) -> DataFrame:
    """candidate_id, prompt of the control condition: the message and the lines around it, and nothing that was retrieved; files: path, text."""
    from ..functions.prompts import window_prompt

    rows = candidates.join(files.select("path", F.split("text", "\n").alias("__lines")), "path")
    first = F.greatest(F.lit(1), F.col("line") - lines)
    last = F.least(F.size("__lines"), F.col("line") + lines)
    body = F.array_join(F.slice("__lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return rows.select("candidate_id", window_prompt(F.col("message"), F.col("path"), first, last, body).alias("prompt"))


def naive_findings(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings of the control: what it confirmed, at the candidate's own place, cited by nothing."""
    return candidates.join(outcomes.where("answered and verdict = 'confirmed'").select("candidate_id", F.col("cwe").alias("found_cwe"), "rationale"), "candidate_id").select("candidate_id", "case_id", "path", "line", F.col("found_cwe").alias("cwe"), "rationale")


def adjudicated_cases(cases: DataFrame, outcomes: DataFrame, indexed: DataFrame) -> DataFrame:
    """case_id, status, findings, confirmed: every case, also those that could not be indexed (never as cases without findings).

    outcomes: case_id, answered, verdict; indexed: case_id.
    """
    counted = outcomes.groupBy("case_id").agg(F.count_if("answered").alias("findings"), F.count_if(F.col("answered") & (F.col("verdict") == "confirmed")).alias("confirmed"))
    marked = cases.select("case_id").join(indexed.select("case_id").distinct().withColumn("__ok", F.lit(True)), "case_id", "left").join(counted, "case_id", "left")
    zero = lambda c: F.when(F.col("__ok"), F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(c)
    return marked.select("case_id", F.when(F.col("__ok"), "adjudicated").otherwise("unindexable").alias("status"), zero("findings"), zero("confirmed"))


def tools_baseline(files: DataFrame, root: str, runner: Callable[[str, str, list[str]], tuple[str, str]], analyzers: Sequence[str], producer: str) -> dict[str, DataFrame]:
    """Candidates of analyzers run on each source file, and the runs that failed: a real toolchain in place of recordings.

    files: path, content, starts, arguments. runner is the caller's; nothing runs without it.
    """
    from ..sources import diagnostics
    from .scan import run_analyzers, run_limitations

    names = files.sparkSession.createDataFrame([(a,) for a in analyzers], "analyzer string")
    runs = run_analyzers(files.select("path", "arguments"), names, runner)
    found = diagnostics.parse_text(runs.where("status = 'ok'").select(F.concat_ws(":", "analyzer", "unit").alias("run"), "text"))
    return {"candidates": diagnostics.candidates(found, files, root, producer), "limitations": run_limitations(runs)}


def requests(prompts: DataFrame, issued: DataFrame, severities: DataFrame, per_run: int, per_candidate: int) -> DataFrame:
    """candidates for adjudicate(): prompts (candidate_id, place, prompt) with their ids, and starved where the run's budget had ended.

    The ledger is a running total of numbers in visiting order; a candidate
    takes what its prompt is estimated at, within its own allowance.
    """
    from ..operators.budget import ledger

    sizes = prompts.select("candidate_id", "place", token_estimate(F.col("prompt")).alias("tokens"))
    starved = ledger(sizes, per_run, per_candidate).select("candidate_id", "starved")
    ids_of = issued.groupBy("candidate_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("issued"))
    return prompts.join(starved, "candidate_id").join(ids_of, "candidate_id", "left").join(severities, "candidate_id", "left").select("candidate_id", "prompt", "issued", "severity", F.lit(True).alias("triage"), "starved")


def answers_for_gate(outcomes: DataFrame) -> DataFrame:
    """Outcomes as the gate's answers, with those that were refused as candidates for review."""
    kept = outcomes.where("answered").select("candidate_id", "verdict", "cwe", F.col("rationale").alias("cwe_rationale"), "cited")
    return kept


def refused_candidates(outcomes: DataFrame) -> DataFrame:
    return gate.refused(outcomes.where("not answered").select("candidate_id"), F.lit("")).drop("reason", "confidence").join(outcomes.select("candidate_id", "reason"), "candidate_id")
