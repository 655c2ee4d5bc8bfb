"""Speaker-to-member matching: exact, chair, congress, disambiguated, similar.

All stages work on the distinct (hearing, name) pairs, a small fraction of the
sentences; each stage only decides pairs that earlier stages left open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.barrier import computed_once
from ..session import cut_lineage
from . import relational as rel

PAIR = ["hearing_id", "speaker_last_name", "speaker_last_word", "congress", "committee_code"]
_MEMBER = ["bioguide_id", "last_name", "first_name", "party", "state"]


def _hit(bioguide: Column, score: Column, label: Column) -> Column:
    """What a stage decides; the member's other attributes are joined once at the end."""
    return F.struct(
        bioguide.alias("bioguide_id"), score.cast("double").alias("match_score"), label.alias("match_type")
    )


def by_full_name(lookup: DataFrame) -> DataFrame:
    """A row per congress, last and first name of the lookup, with its least member and its number of rows `_n`.

    The cascade asks no more of namesakes, however many they are; every step that takes a lookup takes this one too.
    """
    return lookup.groupBy("congress", "last_name_upper", "first_name").agg(F.count(F.lit(1)).alias("_n"), F.min("bioguide_id").alias("bioguide_id"))


def _rows_of(lookup: DataFrame) -> Column:
    """How many rows of the member lookup a row stands for."""
    return F.col("_n") if "_n" in lookup.columns else F.lit(1).cast("bigint")


def unambiguous(lookup: DataFrame, block: str) -> DataFrame:
    """Names carried by exactly one lookup row within the block, with that row's member."""
    rows = lookup.filter(F.col("last_name_upper").isNotNull() & F.col(block).isNotNull())
    g = rows.groupBy(block, "last_name_upper").agg(F.sum(_rows_of(lookup)).alias("_n"), F.min("bioguide_id").alias("bioguide_id"))
    return g.filter(F.col("_n") == 1).drop("_n")


def exact_names(pairs: DataFrame, unique: DataFrame, block: str, label: str, out: str = "hit") -> DataFrame:
    """Full-name match, else last-word match, inside the block. Adds one struct column."""
    look = unique.select(block, F.col("last_name_upper").alias("_name"), _hit(F.col("bioguide_id"), F.lit(100.0), F.lit(label)).alias("_h"))
    full = look.select(block, F.col("_name").alias("speaker_last_name"), F.col("_h").alias("_full"))
    word = look.select(block, F.col("_name").alias("speaker_last_word"), F.col("_h").alias("_word"))
    got = pairs.join(full, [block, "speaker_last_name"], "left").join(word, [block, "speaker_last_word"], "left")
    return got.withColumn(out, F.coalesce("_full", "_word")).select(*pairs.columns, out)


def chairs(pairs: DataFrame, leaders: DataFrame, members: DataFrame, out: str = "hit") -> DataFrame:
    """Anonymous chairs resolved through the committee's first listed chair."""
    order = ["ord", "bioguide_id"] if "ord" in leaders.columns else ["bioguide_id"]
    first = rel.first_by(leaders.filter(F.col("role") == "chair"), ["congress", "thomas_id"], order)
    hit = _hit(F.col("bioguide_id"), F.lit(100.0), F.lit("committee_chair_exact"))
    known = rel.keep_in(first, members, "bioguide_id").select("congress", F.col("thomas_id").alias("_thomas"), hit.alias(out))
    thomas = F.when(
        F.col("speaker_last_name").isin(*names.CHAIR_NAMES), names.parent_committee(F.col("committee_code"))
    )
    return pairs.withColumn("_thomas", thomas).join(known, ["congress", "_thomas"], "left").select(*pairs.columns, out)


def disambiguated(open_names: DataFrame, lookup: DataFrame, out: str = "hit") -> DataFrame:
    """Ambiguous names told apart by a first name or initial among the speaker's words.

    The full name is tried before the last word; exactly one candidate must remain.
    """
    both = open_names.withColumn(
        "_try",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("rank"), F.col("speaker_last_name").alias("name")),
                F.struct(F.lit(1).alias("rank"), F.col("speaker_last_word").alias("name")),
            )
        ),
    ).filter((F.col("_try.rank") == 0) | (F.col("speaker_last_word") != F.col("speaker_last_name")))
    tried = both.select(*open_names.columns, F.col("_try.rank").alias("_rank"), F.col("_try.name").alias("last_name_upper"))
    look = lookup.select("congress", "last_name_upper", "bioguide_id", "first_name", _rows_of(lookup).alias("_n"))
    words = F.split("speaker_last_name", " ")
    first = F.upper(F.trim("first_name"))
    fits = (first != "") & (F.array_contains(words, first) | F.array_contains(words, F.substring(first, 1, 1)))
    cand = tried.join(look, ["congress", "last_name_upper"]).withColumn("_fit", F.coalesce(fits, F.lit(False)))
    per_try = cand.groupBy(*open_names.columns, "_rank").agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(F.col("_fit"), F.col("_n"))).alias("_fits"),
        F.min(F.when(F.col("_fit"), F.col("bioguide_id"))).alias("_one"),
        F.min("bioguide_id").alias("_any"),
    )
    label = F.when(F.col("_rows") > 1, "exact_disambiguated").when(F.col("_rank") == 0, "exact").otherwise("exact_last_word")
    member = F.when(F.col("_rows") == 1, F.col("_any")).when(F.col("_fits") == 1, F.col("_one"))
    decided = per_try.select(*open_names.columns, "_rank", member.alias("_m"), label.alias("_l")).filter(F.col("_m").isNotNull())
    best = rel.first_by(decided, open_names.columns, ["_rank"])
    return best.select(*open_names.columns, _hit(F.col("_m"), F.lit(100.0), F.col("_l")).alias(out))


# ---- similarity join ------------------------------------------------------------------


#: Shared tokens that a candidate pair shows, by gram length; the guaranteed number is at least that.
_SHOWN = {3: 3, 2: 2, 1: 1}


def _shared_grams(q: int, total: str, c: float) -> str:
    """Grams of q letters that two strings of `total` letters share at least, if they reach the cutoff.

    Their common subsequence has L = ceil(c * total / 2) letters; a letter outside it breaks q grams
    of its own string and q - 1 of the other.
    """
    return f"({2 * q - 1} * cast(ceil(({total}) * {c / 2:.12f}D - 1e-9D) as int) - {q - 1} * ({total}) - {q - 1})"


def _gram_length(total: str, c: float) -> str:
    """The longest grams of which a pair of that total length shares more than it has to show."""
    return f"(case when {_shared_grams(3, total, c)} > {_SHOWN[3]} then 3 when {_shared_grams(2, total, c)} > {_SHOWN[2]} then 2 else 1 end)"


def _gram_tokens(df: DataFrame, col: str, c: float) -> DataFrame:
    """A row per (string, gram length that some partner calls for, gram): `_id`, `_n`, `_q`, `_t`, `_tok`.

    A gram carries its occurrence number in the string. `_t` is the least number of grams shared with a
    partner of that gram length.
    """
    lo = f"_n + greatest(1, cast(ceil(_n * {c / (2 - c):.12f}D - 1e-9D) as int))"
    hi = f"_n + greatest(1, cast(floor(_n * {(2 - c) / c:.12f}D + 1e-9D) as int))"
    bound = "case q " + " ".join(f"when {q} then {_shared_grams(q, 's', c)}" for q in _SHOWN) + " end"
    least = f"array_min(transform(filter(sequence({lo}, greatest({lo}, {hi})), s -> {_gram_length('s', c)} = q), s -> {bound}))"
    kinds = F.expr(f"filter(transform(array(1, 2, 3), q -> named_struct('q', q, 't', {least})), x -> x.t is not null and x.q <= _n)")
    x = df.select("*", F.explode(kinds).alias("_k")).select(*df.columns, F.col("_k.q").alias("_q"), F.col("_k.t").alias("_t"))
    grams = computed_once(x, {"_g": F.expr(f"transform(sequence(1, _n - _q + 1), i -> substr({col}, i, _q))")})
    numbered = F.expr("transform(_g, (g, i) -> concat(g, '#', size(filter(slice(_g, 1, i), x -> x = g))))")
    return grams.withColumn("_tok", F.explode(numbered)).drop("_g")


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, cutoff: float) -> DataFrame:
    """Exact similarity join: all distinct (block, a, b) with similarity >= cutoff, scored.

    Similarity is 200 * LCS / (len a + len b). A pair that reaches the cutoff shares a known
    number of letter grams, three, two or one letter long by the length of the pair. With grams in order
    of their rarity, it must then share some among the rarest of each string, so only those
    are joined: common grams are never keys, no string falls back to an empty one, and a
    string takes as many rows as it has letters. Candidates travel as hashes of their strings; pairs
    that show too few shared grams go at once, and a lower bound of the edits goes before the score.
    """
    if not 50 < cutoff <= 100:
        raise ValueError("cutoff must be above 50")
    c = cutoff / 100.0

    def named(df, col):
        known = df.select(*block, col).filter(F.length(col) > 0).distinct()
        return known.withColumns({"_id": F.xxhash64(*block, col), "_n": F.length(col)})

    lefts, rights = named(left, a), named(right, b)
    left_tokens, right_tokens = _gram_tokens(lefts, a, c).drop(a), _gram_tokens(rights, b, c).drop(b)
    rarity = left_tokens.select("_q", "_tok").union(right_tokens.select("_q", "_tok")).groupBy("_q", "_tok").agg(F.count(F.lit(1)).alias("_f"))
    shown = F.expr("case _q " + " ".join(f"when {q} then {k}" for q, k in _SHOWN.items()) + " end")

    def rare(tokens, side):
        ranked = tokens.join(rarity, ["_q", "_tok"]).groupBy(*block, "_id", "_n", "_q", "_t").agg(F.sort_array(F.collect_list(F.struct("_f", "_tok"))).alias("_all"))
        first = F.slice("_all", F.lit(1), F.least(F.size("_all"), F.size("_all") - F.col("_t") + shown))
        return ranked.select(*block, "_q", F.explode(first["_tok"]).alias("_tok"), F.col("_id").alias(f"_id{side}"), F.col("_n").alias(f"_n{side}"))

    met = rare(left_tokens, "a").join(rare(right_tokens, "b"), [*block, "_q", "_tok"])
    met = met.filter(F.expr(f"{_gram_length('_na + _nb', c)} = _q and least(_na, _nb) >= (_na + _nb) * {c / 2:.12f}D - 1e-9D"))
    pairs = met.groupBy("_ida", "_idb", "_q").agg(F.count(F.lit(1)).alias("_shared")).filter(F.col("_shared") >= shown).select("_ida", "_idb")
    cand = pairs.join(lefts.select(*block, a, F.col("_id").alias("_ida")), "_ida")
    other = rights.select(*[F.col(k).alias(f"_r_{k}") for k in block], b, F.col("_id").alias("_idb"))
    cand = cand.join(other, "_idb").filter(F.expr(" and ".join(["true", *[f"{k} <=> _r_{k}" for k in block]]))).select(*block, a, b)
    total = F.length(a) + F.length(b)
    edits = F.lit(1 - c) * total + 1e-9
    scored = cand.filter(F.levenshtein(a, b) <= edits).withColumn("score", names.long_similarity(F.col(a), F.col(b)))
    return scored.filter(F.col("score") >= cutoff)


def similar_names(open_names: DataFrame, lookup: DataFrame, cutoff: float = 85.0, out: str = "hit") -> DataFrame:
    """Most similar member name in the congress; the winning name must belong to one member.

    Ties in score go to the name that sorts first.
    """
    per_name = (
        lookup.filter(F.col("last_name_upper").isNotNull())
        .groupBy("congress", "last_name_upper")
        .agg(F.sum(_rows_of(lookup)).alias("_n"), F.min("bioguide_id").alias("_m"))
    )
    pairs = similar_pairs(open_names, per_name, ["congress"], "speaker_last_name", "last_name_upper", cutoff)
    best = rel.first_by(
        pairs.withColumn("_neg", -F.col("score")), ["congress", "speaker_last_name"], ["_neg", "last_name_upper"]
    )
    won = best.join(per_name.filter(F.col("_n") == 1), ["congress", "last_name_upper"])
    return won.select(
        "congress", "speaker_last_name", _hit(F.col("_m"), F.col("score"), F.lit("fuzzy")).alias(out)
    )


def names_of_hearings(hearing_map: DataFrame) -> DataFrame:
    """(hearing_id, _names): each hearing's unambiguous names with their member, as many as members attend."""
    entry = F.struct(F.col("last_name_upper"), F.col("bioguide_id"))
    return unambiguous(hearing_map, "hearing_id").groupBy("hearing_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))


def asked_names(pairs: DataFrame) -> DataFrame:
    """(hearing_id, name): the names that the rules look for in a hearing."""
    return pairs.select("hearing_id", F.explode(F.array("speaker_last_name", "speaker_last_word")).alias("name"))


def in_hearing(pairs: DataFrame, hearing_map: DataFrame, out: str = "hit") -> DataFrame:
    """Full-name match, else last-word match, among the hearing's names.

    Hearings bring their names along in one row, so full name and last word take one join on the hearing.
    """
    found = pairs.join(names_of_hearings(hearing_map), "hearing_id", "left")
    member = F.coalesce(F.try_element_at("_names", F.col("speaker_last_name")), F.try_element_at("_names", F.col("speaker_last_word")))
    return found.select(*pairs.columns, F.when(member.isNotNull(), _hit(member, F.lit(100.0), F.lit("hearing_member_exact"))).alias(out))


def exact_matches(pairs: DataFrame, hearing_map: DataFrame, lookup: DataFrame, leaders: DataFrame, members: DataFrame, out: str = "_hit") -> DataFrame:
    """`pairs` with the hit of the first exact rule that has one: a name of the hearing, the committee's chair, a name of the congress.

    Pairs are read once: the rules follow each other in one plan.
    """
    found = in_hearing(pairs, hearing_map, "_a")
    found = chairs(found, leaders, members, "_c")
    found = exact_names(found, unambiguous(lookup, "congress"), "congress", "congress_exact", "_b")
    return found.select(*pairs.columns, F.coalesce("_a", "_c", "_b").alias(out))


def match_pairs(pairs: DataFrame, hearing_map: DataFrame, lookup: DataFrame, leaders: DataFrame, members: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """The whole cascade for distinct pairs: PAIR columns plus the match columns.

    The lookup and the exact stage's result are written to the checkpoint folder, since the later stages
    read them several times. What is decided and what is not go separate ways, so nulls meet no join.
    """
    lookup = cut_lineage(by_full_name(lookup), large=True)
    m = cut_lineage(exact_matches(pairs, hearing_map, lookup, leaders, members), large=True)
    key = ["congress", "speaker_last_name", "speaker_last_word"]
    chair = F.coalesce(F.col("speaker_last_name").isin(*names.CHAIR_NAMES), F.lit(True))
    can = F.col("_hit").isNull() & F.col("congress").isNotNull() & ~chair
    open_pairs = m.filter(can).drop("_hit")
    left_open = cut_lineage(open_pairs.select(*key).distinct())
    told = cut_lineage(disambiguated(left_open, lookup, "_m"))
    rest = left_open.join(told, key, "left_anti")
    # Written, so that their size is known and the pairs need not move to meet them.
    close = cut_lineage(rest.join(similar_names(rest, lookup, cutoff, "_m"), ["congress", "speaker_last_name"]).select(*key, "_m"))
    late = open_pairs.join(told.select(*key, "_m").union(close), key, "left").select(*pairs.columns, "_m")
    settled = m.filter(~can).select(*pairs.columns, F.col("_hit").alias("_m"))
    done = settled.union(late)
    known = rel.first_by(members.select(*_MEMBER), ["bioguide_id"], ["last_name", "first_name"])
    matched = done.filter(F.col("_m").isNotNull()).select(*pairs.columns, "_m.*").join(known, "bioguide_id", "left")
    return rel.union_all(matched, done.filter(F.col("_m").isNull()).drop("_m")).select(*pairs.columns, *_MEMBER, "match_score", "match_type")


def match_speakers(
    sentences: DataFrame, hearing_map: DataFrame, lookup: DataFrame, leaders: DataFrame, members: DataFrame, cutoff: float = 85.0, facts: DataFrame | None = None
) -> DataFrame:
    """Sentences with match columns: decide each distinct pair once, then join the matched ones back.

    `facts`: a row per (bioguide_id, congress) whose other columns the sentences get too. They meet the pairs, so the sentences need not move for them.
    """
    pairs = sentences.select(*PAIR).distinct()
    decided = match_pairs(pairs, hearing_map, lookup, leaders, members, cutoff)
    matched = decided.filter(F.col("bioguide_id").isNotNull()).select(
        "hearing_id",
        "speaker_last_name",
        "committee_code",
        "bioguide_id",
        F.col("first_name").alias("member_first_name"),
        "party",
        F.col("state").alias("member_state"),
        "match_score",
        "match_type",
    )
    if facts is None:
        return written_back(sentences, matched, ["committee_code"])
    # A pair is written to its hearing's sentences whatever their congress, which decides about the facts.
    held = decided.select("hearing_id", "congress").distinct()
    known = matched.join(held, "hearing_id").join(facts, ["bioguide_id", "congress"], "left")
    return written_back(sentences, known, ["committee_code", "congress"])


def written_back(sentences: DataFrame, matched: DataFrame, nullable: list[str]) -> DataFrame:
    """`sentences` with the columns of the matched pairs of their hearing, name and `nullable` columns, in which null equals null.

    A hearing's pairs come in one row, as many as its speakers, so sentences that lie by hearing already do not move. They lie in slots
    of about eight by the hash of the name, and a sentence looks through one of them.
    """
    name = "speaker_last_name"
    rest = [c for c in matched.columns if c not in ("hearing_id", name, *nullable)]

    def slot(name: Column, n: Column) -> Column:
        return F.pmod(F.hash(name), n)

    def same(x: Column) -> Column:
        return reduce(lambda a, c: a & x[c].eqNullSafe(F.col(c)), nullable, x[name] == F.col(name))

    named = matched.filter(F.col("hearing_id").isNotNull() & F.col(name).isNotNull())
    lists = named.groupBy("hearing_id").agg(F.collect_list(F.struct(name, *nullable, *rest)).alias("_all"))
    n = F.greatest(F.lit(1), F.shiftright(F.size("_all"), 3))
    slots = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter("_all", lambda x: slot(x[name], n) == i))
    found = sentences.join(lists.select("hearing_id", slots.alias("_slots")), "hearing_id", "left")
    near = F.get("_slots", slot(F.col(name), F.size("_slots")))
    out = found.select(*sentences.columns, F.explode_outer(F.filter(near, same)).alias("_hit"))
    return out.select(*sentences.columns, *[F.col("_hit")[c].alias(c) for c in rest])


def without_late_witnesses(df: DataFrame) -> DataFrame:
    """Drop unmatched single-word speakers who are not chairs: they are witnesses after all."""
    single = F.col("speaker_last_name").eqNullSafe(F.col("speaker_last_word"))
    chair = F.coalesce(F.col("speaker_last_name").isin(*names.CHAIR_NAMES), F.lit(False))
    return df.filter(~(single & F.col("bioguide_id").isNull() & ~chair))


def without_outsiders(df: DataFrame) -> DataFrame:
    """Drop matched members with neither an ideology score nor seniority: not House members."""
    return df.filter(F.col("bioguide_id").isNull() | F.col("nominate_dim1").isNotNull() | F.col("seniority").isNotNull())


def low_confidence(df: DataFrame, below: float = 80.0, k: int = 50) -> DataFrame:
    """Distinct weak matches for review, lowest score first (a report of k rows)."""
    weak = df.filter((F.col("match_score") > 0) & (F.col("match_score") < below))
    cols = ["speaker", "last_name", "match_score", "match_type"]
    return weak.select(*[c for c in cols if c in df.columns]).distinct().orderBy(*[c for c in ("match_score", "speaker", "last_name") if c in df.columns]).limit(k)


def match_report(df: DataFrame) -> DataFrame:
    """Rows and share per match type; unmatched rows appear as `unmatched`."""
    by_type = cut_lineage(df.groupBy(F.coalesce("match_type", F.lit("unmatched")).alias("match_type")).agg(F.count(F.lit(1)).alias("n")))
    total = by_type.agg(F.sum("n")).scalar()
    return by_type.withColumn("share", F.col("n") / total.cast("double"))
