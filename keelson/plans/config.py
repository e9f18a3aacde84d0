"""Switches of an analysis; every operator that depends on one takes this object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisConfig:
    restrictive_pk_coordination: bool = True
    restrictive_fk_coordination: bool = True
    transitive_references: bool = True
    references_from_read_read: bool = True
    references_from_read_value_key: bool = False
    nosql_indexes_as_primary_keys: bool = False
    concurrency_includes_upserts: bool = False
    propagate_across_queues: bool = True
    #: Pairs of reads are met in a pass of their own, after all other pairs.
    dual_pass: bool = False
    #: False: "db.t.ID" counts as upper path of "db.t.IDCard", as in plain string comparison.
    segment_aware_paths: bool = False
