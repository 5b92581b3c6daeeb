"""A run from sources to clusters and coverage: stages written as tables, a journal, checkpoints, and the library's API.

Each stage is a DataFrame written to `<root>/<run>/<stage>`, so a run can be inspected and resumed. Control (states,
journals, decisions, first responses) is a small document a run under `<root>/_control`: an engine that is made anew on
the same root goes on with the runs it finds there.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.config import REGIONS, Settings
from selvage.operators import agents, emit, gate, match, model, retrieval
from selvage.sources import connectors, parsers


#: States in which a run of a domain lets another one begin.
DONE = ("RELEASED", "FAILED")
RESPONSES = "responses.json"


class EngineError(Exception):
    status, title = 500, "internal"


class NotFound(EngineError):
    status, title = 404, "not found"


class Conflict(EngineError):
    status, title = 409, "conflict"


class Invalid(EngineError):
    status, title = 400, "invalid"


class GatesClosed(EngineError):
    status, title = 422, "a coverage gate does not pass"


def problem(error: EngineError, instance: str) -> dict:
    """An error as a problem document."""
    return {"type": f"about:blank#{error.title.replace(' ', '-')}", "title": error.title, "status": error.status, "detail": str(error), "instance": instance}


def cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode()


def offset_of(text: str | None) -> int:
    if not text:
        return 0
    try:
        return int(base64.urlsafe_b64decode(text.encode()).decode())
    except ValueError:
        raise Invalid("malformed cursor") from None


@dataclass
class Engine:
    """spark, root (a folder that all executors share), settings, and the regions' keys."""

    spark: SparkSession
    root: str
    keys: dict[str, bytes]
    settings: Settings = field(default_factory=Settings)
    states: dict[str, dict] = field(default_factory=dict)
    responses: dict[tuple[str, str], object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, text in self._stored():
            document = json.loads(text)
            if name == RESPONSES:
                self.responses = {(route, key): value for route, key, value in document}
            else:
                self.states[document["runId"]] = document

    # --- control ---

    def _path(self, *parts: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, "_control", *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self) -> list[tuple[str, str]]:
        folder, fs = self._path()
        if not fs.exists(folder):
            return []
        files = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
        return [(f.getName(), self.spark.read.text(f.toString(), wholetext=True).first()[0]) for f in files]

    def _store(self, name: str, document: object) -> None:
        """Written beside and put in place, so a reader finds the old document or the new one."""
        beside, fs = self._path(f"{name}.new")
        path, _ = self._path(name)
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(beside, path)

    def save(self, run_id: str) -> None:
        self._store(f"run-{hashlib.sha256(run_id.encode()).hexdigest()[:32]}.json", self.states[run_id])

    # --- tables ---

    def write(self, df: DataFrame, run_id: str, stage: str) -> DataFrame:
        path = f"{self.root}/{run_id}/{stage}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def read(self, run_id: str, stage: str) -> DataFrame:
        self.state(run_id)
        return self.spark.read.parquet(f"{self.root}/{run_id}/{stage}")

    def state(self, run_id: str) -> dict:
        if run_id not in self.states:
            raise NotFound(run_id)
        return self.states[run_id]

    def note(self, run_id: str, kind: str, **detail: object) -> None:
        events = self.state(run_id)["journal"]
        events.append({"runId": run_id, "seq": len(events) + 1, "at": datetime.datetime.now(datetime.UTC).isoformat(), "kind": kind, "detail": json.dumps(detail, sort_keys=True)})
        self.save(run_id)

    def journal(self, run_id: str, from_seq: int = 1, most: int = 100) -> list[dict]:
        return [e for e in self.state(run_id)["journal"] if e["seq"] >= from_seq][:most]

    def once(self, route: str, key: str | None, call) -> object:  # noqa: ANN001
        """The first response (a JSON value) of a route and key, also for repeats and after a restart."""
        if key is None:
            return call()
        if (route, key) not in self.responses:
            self.responses[route, key] = call()
            self._store(RESPONSES, [[r, k, v] for (r, k), v in self.responses.items()])
        return self.responses[route, key]

    # --- stages ---

    def create_run(self, run_id: str, domain: str, raw: DataFrame, classify=None) -> dict:  # noqa: ANN001
        """Relevance, gate, ledger, manifest, attributes and clusters of raw(uri, system, region, version, media_type, content,
        catalogue_domain, has_live_route)."""
        if run_id in self.states:
            raise Conflict(f"{run_id} exists")
        if active := [r for r, s in self.states.items() if s["domain"] == domain and s["state"] not in DONE]:
            raise Conflict(f"{domain} has the active run {active[0]}")
        self.states[run_id] = {"runId": run_id, "domain": domain, "state": "RUNNING", "journal": []}
        self.note(run_id, "stage-started", stage="S1")
        kept, excluded = connectors.filter_relevant(raw, domain, self.settings, classify)
        own = connectors.artefacts(kept).withColumnRenamed("media_type", "mediaType").withColumn("runId", F.lit(run_id))
        texts = parsers.structures(own, "artefactId", "region", "contentHash", "licence", "system", "uri", "mediaType", "evidenceTier", "runId", "content")
        prose = F.array_join("prose", "\n")
        found = texts.withColumn("spans", gate.spans(prose, F.col("structural"), F.col("examples")))
        found = found.withColumn("labels", gate.labels(F.col("spans"), prose != "")).withColumn("policy", gate.policy(F.col("labels"), F.col("licence"), F.lit(True)))
        verdict = F.when(F.col("policy.verdict") == "block", "block").otherwise(gate.verdict(F.col("labels")))
        gated = self.write(found.withColumn("verdict", verdict), run_id, "gated")
        passed = gated.where("verdict <> 'block'")
        masked = None
        for region in REGIONS:  # a key for each region, never mixed
            part = passed.where(F.col("region") == region)
            if region in self.keys:
                part = part.withColumn("content", F.encode(gate.redact(F.decode("content", "UTF-8"), F.col("spans"), self.keys[region]), "UTF-8"))
            else:
                part = part.where(F.raise_error(F.lit(f"no key for {region}")).isNotNull())  # fails only if there is a row
            masked = part if masked is None else masked.union(part)
        clean = self.write(masked.drop("spans", "labels", "policy", "structural", "examples", "prose"), run_id, "artefacts")
        self.write(excluded.union(gated.where("verdict = 'block'").select("uri", gate.exclusion(F.col("policy.rule")), F.col("policy.reason"), F.lit("gate"))), run_id, "exclusions")
        entry = {"artefactId": F.col("artefactId"), "contentHash": F.col("contentHash"), "verdict": F.col("verdict"), "policyVersion": F.lit(gate.POLICY_VERSION), "runId": F.lit(run_id)}
        self.write(gate.chain(gated, "region", ["artefactId"], entry), run_id, "ledger")
        corpus = connectors.corpus_hash(clean).first()["corpus_hash"]
        self.note(run_id, "stage-finished", stage="S1", corpusHash=corpus)
        rows = self.write(parsers.attributes(clean), run_id, "attributes")
        self.note(run_id, "stage-finished", stage="S3")
        embedded = rows.where("error IS NULL").withColumn("embedding", retrieval.embed(F.concat_ws(" ", "localName", "semantics.description"), self.settings.embed_dimensions))
        clusters, review = match.run(embedded, self.settings, "embedding")
        self.write(clusters, run_id, "clusters")
        self.write(review, run_id, "triage")
        self.states[run_id] |= {"state": "AWAIT_TRIAGE", "corpusHash": corpus}
        self.note(run_id, "stage-finished", stage="S4")
        return self.state(run_id)

    def resume(self, run_id: str, corpus_hash: str, proposals: DataFrame | None = None) -> dict:
        """Alignment, synthesis and coverage after triage. proposals(clusterId, entity, attribute, rationale) come from a naming
        provider; without one the run waits for it. A corpus that has changed is refused."""
        state = self.state(run_id)
        if state["state"] not in ("AWAIT_TRIAGE", "AWAIT_MODEL_PROVIDER", "PAUSED"):
            raise Conflict(f"{run_id} is {state['state']}")
        if state["corpusHash"] != corpus_hash:
            raise Conflict("the corpus has changed")
        if proposals is None:
            state["state"] = "AWAIT_MODEL_PROVIDER"
            self.save(run_id)
            return state
        clusters, attributes = self.read(run_id, "clusters"), self.read(run_id, "attributes")
        self.write(agents.aligned_without_standard(clusters), run_id, "alignments")
        member = clusters.select("clusterId", F.explode("members").alias("m")).join(attributes.select("attributeId", "dataType", "cardinality", "evidenceTier", "obligation"), F.col("m.attributeId") == F.col("attributeId"))
        level = F.col("obligation.level")
        each = member.groupBy("clusterId").agg(
            F.array_sort(F.collect_set("m.region")).alias("regions"), F.max("evidenceTier").alias("tier"), model.weakest(level).alias("level"), F.min_by("dataType", F.col("m.role")).alias("dataType"), F.min_by("cardinality", F.col("m.role")).alias("cardinality")
        )
        no = F.lit(False)
        placed = each.withColumn("p", model.placement(F.col("regions"), F.col("tier"), no, no, no, no))
        computed = placed.select(
            "clusterId", "dataType", "cardinality", F.struct(F.col("level").alias("level"), F.lit(None).cast("string").alias("condition")).alias("obligation"), model.contract_value(F.col("p")).alias("placement"), F.col("p.rule").alias("placementRule"),
            model.weight(F.col("level")).alias("weight"), (F.col("p.rule") == "5").alias("vendorOnly"),
        )
        candidates = agents.synthesised(proposals, computed).where("attribute IS NOT NULL").withColumn("candidateId", F.concat_ws("/", F.lit("canon:"), "entity", "attribute")).withColumn("clusterRefs", F.array("clusterId"))
        candidates = candidates.withColumn("ratification", F.struct(F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("sme")))
        self.write(candidates, run_id, "candidates")
        state["state"] = "CANDIDATES_READY"
        self.note(run_id, "stage-finished", stage="S7")
        return state

    def decide(self, run_id: str, candidate_id: str, status: str, sme: str, corpus_hash: str | None = None) -> None:
        """A person's decision on a candidate; approved or rejected. corpus_hash: what they saw; another corpus is refused."""
        if corpus_hash is not None and corpus_hash != self.state(run_id).get("corpusHash"):
            raise Conflict("the corpus has changed")
        if status not in ("approved", "rejected") or not sme:
            raise Invalid("a decision is approved or rejected, by somebody")
        candidates = self.read(run_id, "candidates")
        if candidates.where(F.col("candidateId") == candidate_id).isEmpty():
            raise NotFound(candidate_id)
        self.state(run_id).setdefault("decisions", {})[candidate_id] = (status, sme)
        self.note(run_id, "decision", candidateId=candidate_id, status=status, sme=sme)

    def concepts(self, run_id: str) -> DataFrame:
        """The coverage universe as it stands, with the decisions taken so far."""
        candidates = self.read(run_id, "candidates")
        decided = [(k, s, w) for k, (s, w) in self.state(run_id).get("decisions", {}).items()]
        own = self.spark.createDataFrame(decided, "candidateId string, status string, sme string")
        rows = candidates.drop("ratification").join(own, "candidateId", "left").withColumn("ratification", F.struct(F.coalesce("status", F.lit("proposed")).alias("status"), "sme"))
        return model.universe(self.read(run_id, "clusters"), rows, self.read(run_id, "attributes"))

    def coverage(self, run_id: str) -> dict:
        return model.coverage(self.concepts(run_id), self.settings).first().asDict()

    def gaps(self, run_id: str) -> DataFrame:
        return model.gaps(self.concepts(run_id), self.read(run_id, "exclusions").select("uri", "detail"), self.settings)

    def release(self, run_id: str, version: str, key: bytes) -> dict:
        """A signed release of the emitted schemas; refused while a gate does not pass."""
        report = self.coverage(run_id)
        if not all(report[f"gate{k}Pass"] for k in (1, 2, 3)):
            raise GatesClosed(run_id)
        files = {f"{r['scope'].replace(':', '/')}/{r['entity']}.schema.json": r["document"].encode() for r in emit.entity_schemas(self.read(run_id, "candidates")).toLocalIterator()}
        manifest = emit.release(self.state(run_id)["domain"], version, run_id, files, report, key)
        self.state(run_id)["state"] = "RELEASED"
        self.note(run_id, "released", version=version)
        return manifest

    def pause(self, run_id: str) -> None:
        self.state(run_id)["state"] = "PAUSED"
        self.save(run_id)
