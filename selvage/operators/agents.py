"""Agents: a validation ladder around an injected model, budgets, prompts, and guardrails as row filters.

No model is called from here: a provider is a callable. Guardrails are DataFrame expressions that return the rows that
break a rule, so they check any number of proposals at once.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repeats of a step of the ladder, and of a provider that fails.
SCHEMA_RETRIES, REFERENCE_RETRIES, PROVIDER_RETRIES = 2, 1, 5
BLOCKS = ("role", "task", "inputs", "constraints", "output", "refusal")
SURE = 0.80
ESCALATE_BELOW = 0.60


class BudgetExceeded(RuntimeError):
    """A stage has used up its tokens."""


class ProviderFailed(RuntimeError):
    """A provider failed after all repeats."""


class Rejected(ValueError):
    """An answer that the ladder does not let pass."""

    def __init__(self, rung: str, problems: list[str]) -> None:
        super().__init__(f"{rung}: {problems[0]}")
        self.rung, self.problems = rung, problems


@dataclass
class Budget:
    """Tokens of each stage; a text costs a token for four characters."""

    caps: dict[str, int]
    spent: dict[str, int] = field(default_factory=dict)

    def charge(self, stage: str, text: str) -> int:
        cost = -(-len(text) // 4)
        if self.spent.get(stage, 0) + cost > self.caps.get(stage, 0):
            raise BudgetExceeded(stage)
        self.spent[stage] = self.spent.get(stage, 0) + cost
        return cost


def render(blocks: dict[str, str], values: dict[str, str]) -> str:
    """A prompt of the six blocks in order, with {{names}} filled in; a missing block or value is an error."""
    if missing := [b for b in BLOCKS if not blocks.get(b, "").strip()]:
        raise ValueError(f"no {missing[0]} block")

    def fill(m: re.Match) -> str:
        if m[1] not in values:
            raise ValueError(f"no value for {m[1]}")
        return values[m[1]]

    return "\n\n".join(f"# {b}\n{re.sub(r'{{\s*(\w+)\s*}}', fill, blocks[b])}" for b in BLOCKS)


@dataclass
class Gateway:
    """Calls a provider of a tier within a budget, again after a failure, waiting longer each time."""

    providers: dict[str, Callable[[str], str]]
    budget: Budget
    wait: float = 0.0
    journal: list[dict] = field(default_factory=list)

    def complete(self, tier: str, stage: str, prompt: str) -> str:
        cost = self.budget.charge(stage, prompt)
        for attempt in range(PROVIDER_RETRIES + 1):
            try:
                answer = self.providers[tier](prompt)
            except KeyError:
                raise
            except Exception as error:  # noqa: BLE001  any failure of a provider is tried again
                if attempt == PROVIDER_RETRIES:
                    raise ProviderFailed(str(error)) from error
                time.sleep(self.wait * 2**attempt)
                continue
            self.journal.append({"kind": "model-call", "stage": stage, "tokensIn": cost, "tokensOut": self.budget.charge(stage, answer), "attempt": attempt})
            return answer
        raise AssertionError


def invoke(ask: Callable[[list[str]], object], schema: Callable[[object], list[str]], reference: Callable[[object], list[str]], guardrail: Callable[[object], list[str]]) -> object:
    """An answer that passes the rungs: schema (two repeats), references (one), guardrails (none).

    `ask` gets the problems of the answer before; each check returns problems.
    """
    left = {"V1": SCHEMA_RETRIES, "V2": REFERENCE_RETRIES, "V4": 0}
    problems: list[str] = []
    while True:
        answer = ask(problems)
        for rung, check in (("V1", schema), ("V2", reference), ("V4", guardrail)):
            problems = check(answer)
            if problems:
                if not left[rung]:
                    raise Rejected(rung, problems)
                left[rung] -= 1
                break
        else:
            return answer


# --- guardrails: rows that break a rule --------------------------------------------------------------------------------------------

_ECHO = r"(?i)\b(ignore|disregard)\b.{0,40}\bprevious instructions\b"


def scout(verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """uri, problem of verdicts(uri, in_domain, reason) on asked(uri): echoed instructions, no reason, dropped or doubled addresses."""
    echo = verdicts.where(F.col("reason").rlike(_ECHO)).select("uri", F.lit("injection-echo").alias("problem"))
    bare = verdicts.where(F.col("in_domain") & (F.trim(F.coalesce("reason", F.lit(""))) == "")).select("uri", F.lit("no-reason"))
    dropped = asked.select("uri").join(verdicts, "uri", "left_anti").select("uri", F.lit("dropped"))
    doubled = verdicts.groupBy("uri").agg(F.count("*").alias("n")).where("n > 1").select("uri", F.lit("doubled"))
    return echo.union(bare).union(dropped).union(doubled)


def interpreter(attributes: DataFrame, artefact_id: str) -> DataFrame:
    """Attributes without evidence, or with evidence from another artefact."""
    other = F.exists("evidenceRefs", lambda r: F.regexp_extract(r, "^evref://[^/]*/[^/]*/([^@]+)", 1) != artefact_id)
    return attributes.where((F.coalesce(F.size("evidenceRefs"), F.lit(0)) <= 0) | other)


def resolver(clusters: DataFrame, attributes: DataFrame) -> DataFrame:
    """clusterId, rule of clusters(clusterId, members, conflictClass, confidence, dissent, alternatives, evidenceRefs) that break
    G1 (a member exists and shares evidence), G2 (regions merged without class need confidence), G3 (a conflict needs
    alternatives with a reason), G4 (an obligation conflict is real) or G5 (doubt needs a dissent)."""
    regions = F.size(F.array_distinct(F.transform("members", lambda m: m["region"])))
    doubt = F.col("confidence") < SURE
    broken = lambda condition, rule: clusters.where(condition).select("clusterId", F.lit(rule).alias("rule"))
    member = clusters.select("clusterId", "evidenceRefs", F.explode("members.attributeId").alias("attributeId"))
    joined = member.join(attributes.select("attributeId", F.col("evidenceRefs").alias("own"), F.col("obligation.level").alias("level")), "attributeId", "left")
    g1 = joined.where("own IS NULL OR NOT arrays_overlap(own, evidenceRefs)").select("clusterId", F.lit("G1").alias("rule")).distinct()
    one_level = joined.groupBy("clusterId").agg(F.count_distinct("level").alias("n")).where("n < 2")
    g4 = clusters.where("conflictClass = 'obligation'").join(one_level, "clusterId", "left_semi").select("clusterId", F.lit("G4"))
    unexplained = (F.coalesce(F.size("alternatives"), F.lit(0)) <= 0) | F.exists("alternatives", lambda a: F.trim(F.coalesce(a["whyRejected"], F.lit(""))) == "")
    return (
        g1.union(broken((regions > 1) & F.col("conflictClass").isNull() & doubt, "G2"))
        .union(broken(F.col("conflictClass").isNotNull() & unexplained, "G3"))
        .union(g4)
        .union(broken(doubt & (F.trim(F.coalesce("dissent", F.lit(""))) == ""), "G5"))
    )


def escalated(clusters: DataFrame) -> DataFrame:
    """Clusters that a person must look at."""
    return clusters.where((F.col("conflictClass") == "homonym") | (F.col("confidence") < ESCALATE_BELOW))


def aligned_without_standard(clusters: DataFrame) -> DataFrame:
    """Alignment when there is no standard to look up: unassessed for every cluster."""
    return clusters.select("clusterId", F.lit(None).cast("string").alias("acordRef"), F.lit("unassessed").alias("verdict"), F.lit(None).cast("string").alias("deviation"), F.lit("no standard is available").alias("rationale"), "evidenceRefs")


def aligner(alignments: DataFrame) -> DataFrame:
    """Alignments that break a rule: a fit cites a reference, a partial fit a deviation, others neither force one."""
    ref, why = F.col("acordRef").isNotNull(), F.trim(F.coalesce("deviation", F.lit(""))) != ""
    fine = F.when(F.col("verdict") == "fit", ref & ~why).when(F.col("verdict") == "partial", ref & why).when(F.col("verdict").isin("misfit", "unassessed"), ~ref).otherwise(False)
    return alignments.where(~fine)


def synthesised(proposals: DataFrame, computed: DataFrame) -> DataFrame:
    """Proposals(clusterId, entity, attribute, rationale) with placement, obligation, weight and vendorOnly from computed(clusterId, ...):
    what code can decide is not the model's; a cluster without a proposal has none (a gap)."""
    return computed.join(proposals.select("clusterId", "entity", "attribute", "rationale"), "clusterId", "left")
