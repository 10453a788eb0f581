"""Authorisation rules as data: permits and forbids over resource attributes.

A request is a row. It is allowed if a permit holds and no forbid does; the
decision and the ids of the rules that made it are columns, so a gate is one
projection that Catalyst can push filters through.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``when`` maps attribute name -> Column to a condition; null is false."""

    id: str
    permit: bool
    when: Callable[[Callable[[str], Column]], Column]
    principals: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()

    def holds(self, columns: list[str]) -> Column:
        of = lambda c: F.col(c) if c in columns else F.lit(None)
        out = F.coalesce(self.when(of).cast("boolean"), F.lit(False))
        if self.principals:
            out = out & F.coalesce(of("principal").isin(*self.principals), F.lit(False))
        if self.actions:
            out = out & F.coalesce(of("action").isin(*self.actions), F.lit(False))
        return out


def text(of: Callable[[str], Column], name: str) -> Column:
    return F.coalesce(of(name).cast("string"), F.lit(""))


def has_any(of: Callable[[str], Column], name: str, values: list[str]) -> Column:
    have = F.coalesce(of(name).cast("array<string>"), F.array().cast("array<string>"))
    return F.arrays_overlap(have, F.array(*map(F.lit, values)))


def always(of: Callable[[str], Column]) -> Column:
    return F.lit(True)


# Principals, actions, resource types and attribute domains of the rules.
STORE, HANDOFF, ADVOCATE, TOOL, WRITE = "store_finding", "emit_to_seed", "advocate_finding", "execute_tool", "write"
PROOFS = ["analyzer", "code", "hypothesis"]
WITNESSES = ["envelope", "sanitizer", "closed_set", "constant_caller", "wrong_library"]
FACT_TABLES = ["repo_facts", "symbol_index", "routes"]
JOURNAL_PATHS = "%/audit/%"  # where the controller keeps its journals; set it to the folder in use
TOOL_TYPES = {
    "cartographer": ["Audit::RepoIntel", "Audit::Journal"], "specifier": ["Audit::Specifier"], "static_hunter": ["Audit::StaticHunter"],
    "pattern_scout": ["Audit::PatternScout"], "hypothesis_repl": ["Audit::HypothesisRepl"], "chain_builder": ["Audit::ChainBuilder"],
    "devils_advocate": ["Audit::DevilsAdvocate"],
}
REFLECTOR_ACTIONS = (
    "execute_tool", "write_knowledge_triple", "query_findings", "query_finding_detail", "query_taint_chains", "query_attack_chains",
    "store_knowledge", "recall_knowledge", "recall_journal",
)

RULES = [
    Rule("store-needs-citation", False, lambda of: ~has_any(of, "citations", PROOFS), actions=(STORE,)),
    Rule("store-needs-envelope", False, lambda of: of("evidence_envelope_id") == "", actions=(STORE,)),
    Rule("store-needs-specifier-hash", False, lambda of: of("specifier_hash").isNull(), actions=(STORE,)),
    Rule("store-permits-hunters", True, always, ("static_hunter", "pattern_scout"), (STORE,)),
    Rule("store-not-by-readers", False, always, ("cartographer", "devils_advocate", "reflector"), (STORE,)),
    Rule("handoff-needs-verdict", False, lambda of: ~text(of, "advocate_verdict").isin("confirmed", "uncertain"), ("reporter",), (HANDOFF,)),
    Rule("handoff-not-refuted", False, lambda of: text(of, "poc_status") == "refuted", ("reporter",), (HANDOFF,)),
    Rule(
        "handoff-needs-proof", False,
        lambda of: ~(has_any(of, "citations", ["analyzer"]) | (text(of, "poc_status") == "reproduced") | (text(of, "advocate_verdict") == "confirmed")),
        ("reporter",), (HANDOFF,),
    ),
    Rule("handoff-least-severity", False, lambda of: text(of, "severity").isin("low", "info"), ("reporter",), (HANDOFF,)),
    Rule("handoff-permits-reporter", True, always, ("reporter",), (HANDOFF,)),
    Rule(
        "rebuttal-needs-witness", False, lambda of: (text(of, "verdict") == "rebutted") & ~has_any(of, "witness_types", WITNESSES),
        ("devils_advocate",), (ADVOCATE,),
    ),
    Rule("advocate-permits-self", True, always, ("devils_advocate",), (ADVOCATE,)),
    *(
        Rule(f"tools-permit-{who}", True, lambda of, kinds=kinds: of("type").isin(*kinds), (who,), (TOOL,))
        for who, kinds in TOOL_TYPES.items()
    ),
    Rule("facts-permit-cartographer", True, lambda of: of("table").isin(*FACT_TABLES), ("cartographer",), (WRITE,)),
    Rule("journal-permits-controller", True, lambda of: of("path").like(JOURNAL_PATHS), ("audit-controller",), (WRITE,)),
    Rule("orchestrate-permits-controller", True, lambda of: of("resource") == "engagement", ("audit-controller",), ("orchestrate",)),
    Rule("reflector-permits-own", True, always, ("reflector",), REFLECTOR_ACTIONS),
    Rule("reflector-bounded", False, lambda of: ~F.coalesce(of("action").isin(*REFLECTOR_ACTIONS), F.lit(False)), ("reflector",)),
    Rule("network-denied", False, always, actions=("network",)),
    Rule("step-up-for-network", False, lambda of: text(of, "step_up_token") == "", actions=("network",)),
    Rule("step-up-for-secrets", False, lambda of: text(of, "step_up_token") == "", actions=("read_secret",)),
]


def rules_from(folder: str) -> list[Rule]:
    """Rules of the ``.json`` files of a folder, in the order of their names.

    A file has a list of objects: ``id``, ``permit`` (true or false), ``when`` (a SQL
    condition over attributes; absent: always), and lists ``principals`` and
    ``actions`` (absent: any). Two rules of one id are an error."""
    rules: list[Rule] = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".json")):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            for r in json.load(f):
                condition = lambda of, sql=r.get("when", "true"): F.expr(sql)
                rules.append(Rule(r["id"], bool(r["permit"]), condition, tuple(r.get("principals", ())), tuple(r.get("actions", ()))))
    twice = {r.id for r in rules if sum(x.id == r.id for x in rules) > 1}
    if twice:
        raise ValueError(f"rules with the same id: {sorted(twice)}")
    return rules


def authorise(requests: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``allowed`` and ``reasons`` for each request row.

    Requests have ``principal``, ``action`` and whatever attributes the rules
    read; absent ones are null. By default a request is denied; a forbid that
    holds wins over permits. Reasons are the ids of the forbids that hold, or
    of the permits where none does."""
    columns = requests.columns
    listed = lambda permit: F.array_compact(F.array(*(F.when(r.holds(columns), F.lit(r.id)) for r in rules if r.permit == permit)))
    judged = requests.withColumn("_permits", listed(True)).withColumn("_forbids", listed(False))
    allowed = (F.size("_permits") > 0) & (F.size("_forbids") == 0)
    return judged.withColumn("allowed", allowed).withColumn("reasons", F.when(F.size("_forbids") > 0, F.col("_forbids")).otherwise(F.col("_permits"))).drop(
        "_permits", "_forbids"
    )


def gate(rows: DataFrame, principal: str, action: str, rules: list[Rule] = RULES) -> DataFrame:
    """Rows judged as requests of one principal and action; only the rules of that action are looked at."""
    mine = [r for r in rules if (not r.actions or action in r.actions) and (not r.principals or principal in r.principals)]
    judged = authorise(rows.withColumn("principal", F.lit(principal)).withColumn("action", F.lit(action)), mine)
    return judged.drop("principal", "action")


def store_gate(findings: DataFrame, principal: str = "static_hunter") -> DataFrame:
    return gate(findings, principal, STORE)


def handoff_gate(findings: DataFrame) -> DataFrame:
    return gate(findings, "reporter", HANDOFF)


def rebuttal_gate(verdicts: DataFrame) -> DataFrame:
    """The rebuttal rule, and a rebuttal without a reason is denied, too."""
    needs = Rule("rebuttal-needs-reason", False, lambda of: (text(of, "verdict") == "rebutted") & (F.trim(text(of, "reason")) == ""), actions=(ADVOCATE,))
    return gate(verdicts, "devils_advocate", ADVOCATE, [*RULES, needs])
