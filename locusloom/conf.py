"""Configuration of the event scan, clustering and filters: immutable and passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    target_events: tuple[str, ...] = ("INS", "DEL", "CLIPPING")
    min_mapq: int = 0
    filter_duplicates: bool = True
    read_filters: tuple[str, ...] = ()
    min_clipping_len: int = 10
    min_indel_len: int = 50
    overhang: int = 100
    #: Discordant pairs of a nearer insert are left out where the filter `insertSize` is on.
    min_insert_size: int = 5000
    max_ins_dist: int = 200
    max_bkp_dist: int = 50
    min_cluster_size: int = 2
    orient_buffer: int = 200
    min_reads: int = 2
    max_reads: int = 500
    min_normal_reads: int = 1
    max_cv: float = 30.0
    min_resolved: float = 60.0
    target_sv: tuple[str, ...] = ("INS", "DEL")
    target_refs: tuple[str, ...] | None = None
    bin_size: int = 10_000
    meta_buffer: int = 200
    meta_pct: float = 1.0
    del_pct: float = 20.0
    read_size: int = 100
