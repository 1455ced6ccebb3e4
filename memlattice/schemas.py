"""Schemas of the memory tables and the engine's parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_s, _l, _d, _b, _i, _t = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
_sa, _la, _va = T.ArrayType(T.StringType()), T.ArrayType(T.LongType()), T.ArrayType(T.FloatType())


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


SUMMARY = _of(id=_l, document_id=_s, kind=_s, platform=_s, session_id=_s, group_id=_s, user_id=_s, participants=_sa, content=_s, occurred_at=_t, written_at=_t, embedding=_va, summarized=_b, search_text=_s, archived=_b, archived_at=_t, last_recall_at=_t, recall_count=_i)
FACT = _of(id=_l, document_id=_s, platform=_s, user_id=_s, related_user_ids=_sa, display_name=_s, category=_s, statement=_s, confidence=_s, session_id=_s, group_id=_s, evidence_key=_s, occurred_at=_t, written_at=_t, extracted_flag=_i, embedding=_va)
CLUSTER = _of(id=_l, platform=_s, user_id=_s, category=_s, canonical_statement=_s, score=_d, status=_s, evidence_count=_i, evidence_keys=_sa, source_fact_ids=_la, last_evidence_at=_t, occurred_at=_t, replaced_by=_l, written_at=_t, updated_at=_t, embedding=_va, demoted_at=_t, contradicted_at=_t, related_user_ids=_sa)
PROFILE = _of(id=_l, platform=_s, user_id=_s, category=_s, cluster_id=_l, statement=_s, score=_d, created_at=_t, updated_at=_t, related_user_ids=_sa)
ALIAS = _of(id=_l, platform=_s, user_id=_s, name=_s, first_seen=_t, last_seen=_t, source=_s)
EDGE = _of(id=_l, platform=_s, subject_uid=_s, object_uid=_s, subject_name=_s, object_name=_s, relation_label=_s, statement=_s, status=_s, confidence=_s, evidence_count=_i, evidence_keys=_sa, first_seen=_t, last_seen=_t, occurred_at=_t, written_at=_t, supersede_reason=_s, superseded_at=_t, updated_at=_t)
KV = _of(key=_s, value=_s, updated_at=_t)
PENDING = _of(session_key=_s, payload=_s, updated_at=_t)
MIGRATIONS = _of(version=_i, name=_s, applied_at=_t)

TABLES = {"summary": SUMMARY, "fact": FACT, "cluster": CLUSTER, "profile": PROFILE, "alias": ALIAS, "edge": EDGE, "kv": KV, "pending": PENDING, "migrations": MIGRATIONS}

#: Fixed values of the data model.
CATEGORIES = ("identity", "stable", "preference", "commitment", "interaction", "naming", "recent", "uncertain")
CONFIDENCES = ("high", "medium")


@dataclass(frozen=True)
class Config:
    """Defaults of the thresholds; every operator takes them as an argument."""

    start_high: float = 3.0
    start_medium: float = 2.0
    cap: float = 10.0
    promote: float = 6.0
    recent_promote: float = 4.0
    naming_promote: float = 3.0
    demote: float = 2.0
    decay: float = 0.9
    recent_expire_days: int = 30
    commitment_expire_days: int = 60
    sticky: int = 4
    pending_dead_days: int = 90
    anchors: int = 5
    top_k: int = 5
    dedup: float = 0.85
    write_window: int = 8
    rrf_k: int = 60
    rollout_batches: int = 3
    rollout_chars: int = 1500
    cross_session_rows: int = 2
    cross_session_days: int = 30
    alias_cap: int = 8
    half_life_days: float = 90.0
    archive_grace_days: int = 30
    reinforce_days: int = 90
    rerank_candidates: int = 50
    retain_group: int = 1
    retain_private: int = 5
    flush_idle_s: int = 1800

    def archive_days(self) -> int:
        return int(self.archive_grace_days + 3 * self.half_life_days)

    def check(self) -> None:
        """Cross-field rules: a demoted fact must not be promoted again at once, and thresholds lie within the cap."""
        slack = 1e-9
        if self.promote - self.demote + slack < max(self.start_high, self.start_medium):
            raise ValueError("the band between demote and promote is narrower than a start score")
        if self.naming_promote * self.decay + slack < self.demote:
            raise ValueError("a naming fact would fall below demote in one pass")
        if max(self.promote, self.recent_promote, self.naming_promote) > self.cap + slack:
            raise ValueError("a promote threshold exceeds the cap")
