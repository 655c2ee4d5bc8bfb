"""End-to-end composition: transcripts to enriched sentences to a sample."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import matching, members, relational, sampling, transcripts
from ..session import cut_lineage, return_shuffles
from ..sources import stage


@dataclass
class Sources:
    """The dimension and bridge tables that the enrichment joins."""

    hearings: DataFrame
    committees: DataFrame
    dates: DataFrame
    members: DataFrame
    terms: DataFrame
    hearing_members: DataFrame
    ideology: DataFrame
    leaders: DataFrame
    elections: DataFrame
    majority: dict[int, str] = field(default_factory=lambda: dict(members.HOUSE_MAJORITY))
    unified: dict[int, int] = field(default_factory=lambda: dict(members.UNIFIED_GOVERNMENT))
    known_sessions: tuple[int, int] = (115, 119)
    committee_order: list[str] = field(default_factory=lambda: ["committee_code"])
    congresses: list[int] | None = None


def member_lookup(s: Sources) -> DataFrame:
    """(member, congress) lookup from terms, then hearings, then ideology rows.

    Of the members under one id the lookup keeps the one whose last name is first, so the others are left out before they meet the rows.
    """
    cols = [c for c in members.MEMBER_COLS if c != "bioguide_id"]
    known = relational.first_by(s.members.select(*members.MEMBER_COLS), ["bioguide_id"], ["last_name", *cols])
    seen = s.ideology.filter(F.col("chamber") == "House").select("bioguide_id", "congress").distinct()
    from_scores = members.with_name_key(seen.join(known, "bioguide_id"))
    return members.combined_lookup(
        members.lookup_from_terms(known, s.terms, s.congresses),
        members.lookup_from_hearings(s.hearing_members, known, s.hearings),
        from_scores,
    )


def with_hearing_metadata(sentences: DataFrame, s: Sources) -> DataFrame:
    """Hearing attributes, one committee, one date and the speaker's name parts.

    The attributes are a row per hearing and written once; the sentences meet them as often as they are read.
    """
    info = cut_lineage(
        s.hearings.join(members.best_committee(s.committees, s.hearings, s.committee_order), "hearing_id", "left")
        .join(members.resolve_hearing_dates(s.dates, s.hearings, s.known_sessions), "hearing_id", "left"),
        large=True,
    )
    out = sentences.join(info, "hearing_id", "left")
    return out if "speaker_last_name" in out.columns else names.with_name_parts(out)


def match(named: DataFrame, s: Sources, facts: DataFrame | None = None) -> DataFrame:
    """Legislators' sentences with their member and, if given, the facts of member and congress."""
    spoken = named.filter(~text.is_witness(F.col("speaker")))
    hmap = members.hearing_member_map(s.hearing_members, s.members, matching.asked_names(spoken.select(*matching.PAIR).distinct()))
    return matching.match_speakers(spoken, hmap, member_lookup(s), s.leaders, s.members, facts=facts)


def covariates(matched: DataFrame, s: Sources, scores: DataFrame | None = None) -> DataFrame:
    """Party flags, ideology and seniority, leadership and vote share.

    The shares, a row per district, are written: their size is then known and the sentences need not move to meet them.
    `scores`: the ideology covariates, if `matched` has them already.
    """
    out = members.party_flags(matched, s.majority, s.unified)
    if scores is None:
        out = out.join(members.ideology_covariates(s.ideology, s.congresses), ["bioguide_id", "congress"], "left")
    out = matching.without_outsiders(out)
    out = members.leadership_flags(out, s.leaders)
    shares = cut_lineage(members.winning_shares(s.elections, s.congresses), large=True)
    return out.join(shares, ["state_abbrev", "district_code", "congress"], "left")


def enrich(sentences: DataFrame, s: Sources) -> DataFrame:
    named = with_hearing_metadata(sentences, s)
    scores = cut_lineage(members.ideology_covariates(s.ideology, s.congresses), large=True)
    return covariates(matching.without_late_witnesses(match(named, s, scores)), s, scores)


def run(
    texts: DataFrame, s: Sources, out_dir: str, *, congresses: list[int] | None = None, chamber: str | None = None, sample_size: int = 10_000, seed: int = 42
) -> dict[str, DataFrame]:
    """Texts to written stage tables and a report: sentences, enriched, sample, report.

    Only hearings of the wanted congresses and chamber are read. The raw sentences are reused while
    their texts, hearings and filters are the same; what is derived from them is built anew.
    A sentence_id names a sentence in every table. Each stage is a Parquet table in the shared
    `out_dir`, so a lost executor costs only the tasks it was running.
    """
    spark = texts.sparkSession
    hearings = s.hearings
    if congresses:
        hearings = hearings.filter(F.col("congress").isin(list(congresses)))
    if chamber:
        hearings = hearings.filter(F.lower("chamber") == chamber.lower())
    wanted = relational.keep_in(relational.substantial(texts), hearings, "hearing_id")
    name = F.concat_ws("-", "hearing_id", "chunk_pos", "sent_pos").alias("sentence_id")
    sentences = stage.cached(
        spark, f"{out_dir}/sentences", lambda: transcripts.sentence_records(wanted).select(name, "*"), token=stage.token_of(texts, s.hearings, congresses, chamber)
    )
    enriched = _written(enrich(sentences, s), f"{out_dir}/enriched", ["congress"])
    matched = enriched.filter(F.col("bioguide_id").isNotNull())
    sample = _written(sampling.stratified(matched, "congress", ["sentence_id"], sample_size, seed), f"{out_dir}/sample")
    return {"sentences": sentences, "enriched": enriched, "sample": sample, "report": report(enriched)}


def _written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return_shuffles(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def report(enriched: DataFrame) -> DataFrame:
    """Rows and share by match type, party, chamber and congress: (item, value, n, share)."""
    kinds = {"match_type": "unmatched", "party": "none", "chamber": "none", "congress": "none"}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.coalesce(F.col(c).cast("string"), F.lit(d)).alias("value")) for c, d in kinds.items()]))
    counts = cut_lineage(enriched.select(cells.alias("_c")).groupBy("_c.item", "_c.value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.filter(F.col("item") == "match_type").agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total.cast("double"))
