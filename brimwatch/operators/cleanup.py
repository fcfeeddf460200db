"""Capped clean-up plans over a file inventory (CLN1-CLN4, JN6, JN7, WIN5, WIN6).

Nothing is deleted here: a plan has one row per candidate file with the action
a clean-up run would take.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions import scalar as S
from brimwatch.operators.skew import lookup, skew_join, top_per_key
from brimwatch.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    glob: str
    min_age_days: float
    description: str


# Globs and least ages of the clean-up rules per role, in order of precedence.
PLAYBOOKS: dict[str, tuple[Rule, ...]] = {
    "web": (
        Rule("*.log.[0-9]*", 14, "numbered generations of access and error logs"),
        Rule("*.log.gz", 21, "compressed log generations"),
        Rule("*-archive-*.log*", 14, "web logs that were put into an archive"),
    ),
    "app": (
        Rule("*-archive-*.log*", 30, "logs that the application archived"),
        Rule("*.log.gz", 21, "compressed application logs"),
        Rule("*.log.[0-9]*", 14, "numbered generations of application logs"),
        Rule("junk-*.bin", 0, "padding files of fill tests"),
    ),
    "db": (
        Rule("postgresql-*.log", 30, "database server logs past their use"),
        Rule("postgresql-*.log.gz", 30, "compressed database server logs"),
        Rule("junk-*.bin", 0, "padding files of fill tests"),
    ),
}
FALLBACK_ROLE = "app"

Playbooks = Mapping[str, Sequence[Rule]]

# Files per host and round handed to the sequential part of the plan. Up to this
# number Spark trims a ranked key in every map task (windowGroupLimitThreshold).
ROUND_FILES = 1000


def playbook_role(role: Column, playbooks: Playbooks = PLAYBOOKS) -> Column:
    """JN6. The role itself if it has rules, otherwise the fallback role."""
    return F.when(role.isin(list(playbooks)), role).otherwise(F.lit(FALLBACK_ROLE))


def _rule_structs(playbooks: Playbooks) -> list[Column]:
    """One struct per (role, rule): null unless name pattern and age match."""
    name, whole_days = S.basename(F.col("path")), F.floor(F.col("age_days"))
    out = []
    for role, rules in playbooks.items():
        for number, rule in enumerate(rules, start=1):
            hit = (
                (F.col("playbook") == role)
                & name.rlike(S.glob_regex(rule.glob))
                & (whole_days >= max(1, int(rule.min_age_days)))
            )
            value = F.struct(
                F.lit(number).alias("rule_no"), F.lit(rule.description).alias("matched_rule")
            )
            out.append(F.when(hit, value))
    return out


def with_host_rules(
    files: DataFrame, hosts: DataFrame, as_of: datetime, playbooks: Playbooks = PLAYBOOKS
) -> DataFrame:
    """Files with age, root and playbook of their host. Files of unknown hosts drop out."""
    owners = hosts.select(
        "host_id", "monitored_path", playbook_role(F.col("role"), playbooks).alias("playbook")
    )
    joined = skew_join(files, owners, ["host_id"], spread=["path"])
    return joined.withColumn("age_days", S.age_days(F.lit(as_of), F.col("mtime")))


def rule_matches(
    files: DataFrame, hosts: DataFrame, as_of: datetime, playbooks: Playbooks = PLAYBOOKS
) -> DataFrame:
    """JN7. Every (file, rule) pair whose name pattern and age match.

    The rules are a handful of literals, so each file tests its own few and no
    second shuffle or cross product is needed.
    """
    rows = with_host_rules(files, hosts, as_of, playbooks)
    tested = rows.withColumn("_hit", F.explode(F.array(*_rule_structs(playbooks))))
    return tested.where(F.col("_hit").isNotNull()).select(
        *rows.columns, "_hit.rule_no", "_hit.matched_rule"
    )


def candidates(
    files: DataFrame, hosts: DataFrame, as_of: datetime, playbooks: Playbooks = PLAYBOOKS
) -> DataFrame:
    """CLN2, WIN5. Each matching file once, under its first matching rule.

    Files that match no rule of any host are dropped before they meet the hosts.
    """
    rows = with_host_rules(files.where(_may_match(as_of, playbooks)), hosts, as_of, playbooks)
    first = reduce(lambda a, b: F.coalesce(a, b), _rule_structs(playbooks))
    return (
        rows.withColumn("_hit", first)
        .where(F.col("_hit").isNotNull())
        .select(
            "host_id", "path", "size_bytes", "mtime", "age_days", "monitored_path",
            "_hit.rule_no", "_hit.matched_rule",
        )
    )


def _may_match(as_of: datetime, playbooks: Playbooks) -> Column:
    """Whether name and age of a file match some rule of any playbook, whatever its host."""
    rules = [rule for some in playbooks.values() for rule in some]
    names = "|".join(f"(?:{S.glob_regex(glob)})" for glob in sorted({rule.glob for rule in rules}))
    least = min(max(1, int(rule.min_age_days)) for rule in rules)
    age = S.age_days(F.lit(as_of), F.col("mtime"))
    return S.basename(F.col("path")).rlike(names) & (F.floor(age) >= least)


def _passes_guards(settings: Settings) -> Column:
    return S.is_under(F.col("path"), F.col("monitored_path")) & (
        F.col("age_days") * 24 >= settings.min_file_age_hours
    )


_ORDER = ("mtime", "rule_no", "path")


def _fold(block: DataFrame, state: DataFrame | None, cap: int, most: int) -> DataFrame:
    """Walk one bounded block per host in order, carrying bytes and files so far."""
    gathered = block.groupBy("host_id").agg(
        F.sort_array(F.collect_list(F.struct(*_ORDER, "size_bytes"))).alias("_files")
    )
    if state is None:
        gathered = gathered.withColumn("freed", F.lit(0).cast("long")).withColumn("taken", F.lit(0))
    else:
        gathered = gathered.join(state.select("host_id", "freed", "taken"), "host_id")
    empty = F.slice(F.col("_files"), 1, 0)
    start = F.struct(F.col("freed").alias("freed"), F.col("taken").alias("taken"), empty.alias("picks"))

    def step(acc: Column, item: Column) -> Column:
        fits = (acc["freed"] + item["size_bytes"] <= cap) & (acc["taken"] < most)
        return F.when(
            fits,
            F.struct(
                (acc["freed"] + item["size_bytes"]).alias("freed"),
                (acc["taken"] + 1).alias("taken"),
                F.concat(acc["picks"], F.array(item)).alias("picks"),
            ),
        ).otherwise(acc)

    walked = gathered.withColumn("_end", F.aggregate("_files", start, step))
    return walked.select(
        "host_id",
        F.col("_end.freed").alias("freed"),
        F.col("_end.taken").alias("taken"),
        F.col("_end.picks").alias("picks"),
        F.element_at("_files", -1).alias("last_seen"),
        # A full block below both caps may have more files behind it.
        (
            (F.size("_files") >= ROUND_FILES)
            & (F.col("_end.taken") < most)
            & (F.col("_end.freed") < cap)
        ).alias("open"),
    )


def capped_picks(candidate_rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """WIN6. Oldest first under a byte cap and a file cap, one row per host.

    A file that does not fit is skipped and later smaller ones still count, so
    the walk is sequential per host. It runs in rounds over at most
    ``ROUND_FILES`` files per host, trimmed before the shuffle; a file larger
    than what is left can never be picked and is filtered out first. Every
    round with a full block picks at least one file, so the file cap also
    bounds the rounds. Results are whole for any number of files per host.
    A round leaves what it could still pick behind: files of hosts that are not
    done, after the last one seen, no larger than what is left. Only these
    survivors are read by the next round.
    """
    cap = int(settings.max_gb_per_run * S.GIB)
    most = settings.max_files_per_run
    order = [F.col(name) for name in _ORDER]
    pool = candidate_rows.where(_passes_guards(settings)).select("host_id", *_ORDER, "size_bytes")
    pool = pool.where(F.col("size_bytes") <= cap)

    state = cut_lineage(_fold(top_per_key(pool, ["host_id"], order, ROUND_FILES), None, cap, most))
    rounds = [state]
    while not state.where("open").isEmpty():
        left = state.where("open").select("host_id", "freed", "taken", "last_seen")
        ahead = skew_join(pool, left, ["host_id"], spread=["path"]).where(
            (F.struct(*_ORDER) > F.struct(*[F.col(f"last_seen.{name}") for name in _ORDER]))
            & (F.col("size_bytes") <= F.lit(cap) - F.col("freed"))
        )
        pool = cut_lineage(ahead.select("host_id", *_ORDER, "size_bytes"))
        state = cut_lineage(_fold(top_per_key(pool, ["host_id"], order, ROUND_FILES), left, cap, most))
        rounds.append(state)
    every = reduce(DataFrame.unionByName, rounds)
    return every.groupBy("host_id").agg(
        F.max("freed").alias("bytes_freed"),
        F.max("taken").alias("files_deleted"),
        F.array_sort(F.flatten(F.collect_list("picks"))).alias("picks"),
    )


def cleanup_plan(
    files: DataFrame,
    hosts: DataFrame,
    as_of: datetime,
    settings: Settings = DEFAULTS,
    playbooks: Playbooks = PLAYBOOKS,
) -> DataFrame:
    """CLN4. One row per candidate with its action.

    delete, skip_outside, skip_age, skip_bytes_cap or skip_file_cap. The
    inventory is read and matched once; the matches are fixed for the rounds.
    """
    rows = cut_lineage(candidates(files, hosts, as_of, playbooks))
    picks = capped_picks(rows, settings)
    chosen = picks.select("host_id", F.explode("picks").alias("_pick")).select(
        "host_id", F.col("_pick.path").alias("path"), F.lit(True).alias("_chosen")
    )
    # Only where the file cap was reached does the end of the walk tell anything.
    ends = picks.where(F.col("files_deleted") >= settings.max_files_per_run).select(
        "host_id",
        F.col("bytes_freed").alias("_freed"),
        F.col("files_deleted").alias("_taken"),
        F.try_element_at("picks", F.lit(-1)).alias("_last"),
    )
    marked = skew_join(
        rows.join(chosen, ["host_id", "path"], "left"), lookup(ends), ["host_id"], "left", spread=["path"]
    )
    cap = int(settings.max_gb_per_run * S.GIB)
    after_last = F.struct(*_ORDER) > F.struct(*[F.col(f"_last.{name}") for name in _ORDER])
    full = (
        (F.col("_taken") >= settings.max_files_per_run)
        & after_last
        & (F.col("_freed") + F.col("size_bytes") <= cap)
    )
    action = (
        F.when(~S.is_under(F.col("path"), F.col("monitored_path")), "skip_outside")
        .when(F.col("age_days") * 24 < settings.min_file_age_hours, "skip_age")
        .when(F.col("_chosen"), "delete")
        .when(full, "skip_file_cap")
        .otherwise("skip_bytes_cap")
    )
    return marked.select(
        "host_id", "path", "size_bytes", "age_days", "rule_no", "matched_rule", action.alias("action")
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """AG19. Bytes and files a plan frees, per host."""
    delete = F.col("action") == "delete"
    return plan.groupBy("host_id").agg(
        F.coalesce(F.sum(F.when(delete, F.col("size_bytes"))), F.lit(0)).alias("bytes_freed"),
        F.count_if(delete).cast("int").alias("files_deleted"),
        F.count("*").alias("n_candidates"),
    )
