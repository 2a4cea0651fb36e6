"""Evidence of two sides joined on a pair key: phases, years and reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank of each phase, by its spelling without case and blanks.
PHASES = {"NA": -1.0, "EARLY_PHASE1": 0.0, "EARLYPHASE1": 0.0, "PHASE1": 1.0, "PHASE1/PHASE2": 1.5, "PHASE2": 2.0, "PHASE2/PHASE3": 2.5, "PHASE3": 3.0, "PHASE4": 4.0}
COMPLETED = "COMPLETED"


def canonical_phase(phase: Column) -> Column:
    """One spelling for both vocabularies (``Phase 2/Phase 3``, ``PHASE2/PHASE3``)."""
    p = F.regexp_replace(F.upper(phase), r"\s+", "")
    return F.when(p.isin("N/A", "NOTAPPLICABLE", ""), "NA").otherwise(p)


def phase_rank(phase: Column) -> Column:
    """-1 where the phase is unknown."""
    out = F.lit(-1.0)
    for name, rank in PHASES.items():
        out = F.when(canonical_phase(phase) == name, rank).otherwise(out)
    return out


def max_phase(phases: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(phases, phase_rank)), F.lit(-1.0))


def has_part(phase: Column, name: str) -> Column:
    """Whether any part of a combined phase is ``name``."""
    return F.coalesce(F.array_contains(F.split(canonical_phase(phase), "/"), name), F.lit(False))


def milestones(df: DataFrame) -> DataFrame:
    """Adds max_phase, any_phase3, any_phase4, completed_phase3, first_start, first_phase4, first_completed_phase3 and reached.

    Needs phase, overall_status, trial_start_year and final_trial_year, aligned by place. Nulls are skipped.
    """
    z = F.arrays_zip("phase", "overall_status", "trial_start_year", "final_trial_year")
    with_z = df.withColumn("z", z)
    third = F.filter("z", lambda t: has_part(t["phase"], "PHASE3") & (F.upper(F.trim(t["overall_status"])) == COMPLETED))
    fourth = F.filter("z", lambda t: has_part(t["phase"], "PHASE4"))
    out = with_z.withColumns(
        {
            "max_phase": max_phase(F.col("phase")),
            "any_phase3": F.coalesce(F.exists("phase", lambda p: has_part(p, "PHASE3")), F.lit(False)),
            "any_phase4": F.coalesce(F.exists("phase", lambda p: has_part(p, "PHASE4")), F.lit(False)),
            "completed_phase3": F.coalesce(F.size(third) > 0, F.lit(False)),
            "first_start": F.array_min("trial_start_year"),
            "first_phase4": F.array_min(F.transform(fourth, lambda t: t["trial_start_year"])),
            "first_completed_phase3": F.array_min(F.transform(third, lambda t: t["final_trial_year"])),
        }
    ).drop("z")
    approved = F.col("fda_earliest_year").isNotNull() if "fda_earliest_year" in df.columns else F.lit(False)
    return out.withColumn("reached", F.col("any_phase4") | F.col("completed_phase3") | approved)


def pair_features(evidence: DataFrame) -> DataFrame:
    """One row for each pair that both sides have, with its counts and features; no lists are built.

    ``evidence``: pair, doc, clinical (whether the row is clinical too), phase, status, start, final, year. Documents are counted once a pair;
    of a pair's clinical rows of one document the least (phase, status, start, final) counts, of preclinical years the least. Both sides go
    through one shuffle by pair and document, and one by pair, each with partial sums before, so a pair with a third of all rows is no burden.
    """
    trial = F.struct("phase", "status", "start", "final")
    docs = evidence.groupBy("pair", "doc").agg(F.min(F.when(F.col("clinical"), trial)).alias("t"), F.min("year").alias("year"))
    t = F.col("t")
    done = has_part(t["phase"], "PHASE3") & (F.upper(F.trim(t["status"])) == COMPLETED)
    fourth = has_part(t["phase"], "PHASE4")
    no = lambda c: F.coalesce(c, F.lit(False))
    g = docs.groupBy("pair").agg(
        F.count("t").alias("clinical_count"),
        F.count("*").alias("preclinical_count"),
        F.max(F.when(t.isNotNull(), phase_rank(t["phase"]))).alias("max_phase"),
        no(F.bool_or(t.isNotNull() & fourth)).alias("any_phase4"),
        no(F.bool_or(t.isNotNull() & no(done))).alias("completed_phase3"),
        F.min(t["start"]).alias("first_start"),
        F.min(F.when(no(done), t["final"])).alias("first_completed_phase3"),
        F.min("year").alias("first_paper"),
        F.max("year").alias("last_paper"),
    )
    return g.where("clinical_count > 0").withColumn("status", F.when(F.col("any_phase4") | F.col("completed_phase3"), "approved").otherwise("failed"))


def percent(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.lit(100.0) * a, b), F.lit(0.0)), 4)


def reach(entities: DataFrame, with_approvals: bool) -> DataFrame:
    """How far what was studied in animals got, as one row.

    ``entities``: one row for each drug or pair, with n (preclinical rows, above 0), clinical, late (a completed phase 3, a phase 4 or an
    approval, among clinical ones), approved, linked. Frequent are those with several rows, or with one and clinical (or, with
    ``with_approvals``, approved alone). Approved without clinical evidence counts as reached and late, but not among the linked.
    """
    one = lambda c: F.coalesce(c, F.lit(False))
    clinical, late, approved, linked = (one(F.col(c)) for c in ("clinical", "late", "approved", "linked"))
    only = approved & ~clinical
    frequent = (F.col("n") > 1) | clinical | (only if with_approvals else F.lit(False))
    n = {
        "total": F.count("*"),
        "frequent": F.count_if(frequent),
        "linked": F.count_if(linked),
        "frequent_linked": F.count_if(frequent & linked),
        "approved_only": F.count_if(only),
        "reached": F.count_if(clinical | only),
        "reached_linked": F.count_if(clinical & linked),
        "late": F.count_if((clinical & late) | only),
        "late_linked": F.count_if(clinical & late & linked),
        "approved": F.count_if(approved),
        "reached_often": F.count_if(clinical & (F.col("n") > 1)),
    }
    over = [("reached", "total"), ("reached", "frequent"), ("reached_linked", "linked"), ("reached_linked", "frequent_linked"), ("late", "total"), ("late", "frequent"), ("late_linked", "linked"), ("late_linked", "frequent_linked"), ("approved", "total"), ("approved", "frequent")]
    sums = entities.agg(*[v.alias(k) for k, v in n.items()])
    return sums.select("*", *[percent(F.col(a), F.col(b)).alias(f"pct_{a}_of_{b}") for a, b in over])


def reach_by_drug(pairs: DataFrame, drug: str) -> DataFrame:
    """Mean over drugs of the share of their pairs that reached each end, in percent, and how many drugs: of all pairs and of the frequent."""
    one = lambda c: F.coalesce(F.col(c), F.lit(False))
    only = one("approved") & ~one("clinical")
    ends = {"any": one("clinical") | only, "late": (one("clinical") & one("late")) | only, "approved": one("approved")}
    often = (F.col("n") > 1) | one("clinical")
    g = pairs.groupBy(drug).agg(F.count("*").alias("k_all"), F.count_if(often).alias("k_frequent"), *[F.count_if(c).alias(f"{e}_all") for e, c in ends.items()], *[F.count_if(c & often).alias(f"{e}_frequent") for e, c in ends.items()])
    share = lambda e, w: F.round(F.coalesce(F.avg(F.try_divide(100.0 * F.col(f"{e}_{w}"), F.col(f"k_{w}"))), F.lit(0.0)), 4).alias(f"macro_{e}_{w}")
    return g.agg(*[share(e, w) for e in ends for w in ("all", "frequent")], *[F.count_if(F.col(f"k_{w}") > 0).alias(f"drugs_{w}") for w in ("all", "frequent")])
