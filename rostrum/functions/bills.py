"""Bill citations, ids, participants, pages and sponsor measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

# Bill types by the letters of their prefix, and how each is displayed.
BILL_TYPES = {
    "HR": "hr",
    "S": "s",
    "HJRES": "hjres",
    "SJRES": "sjres",
    "HCONRES": "hconres",
    "SCONRES": "sconres",
    "HRES": "hres",
    "SRES": "sres",
}
BILL_LABELS = {
    "hr": "H.R.",
    "s": "S.",
    "hjres": "H.J.Res.",
    "sjres": "S.J.Res.",
    "hconres": "H.Con.Res.",
    "sconres": "S.Con.Res.",
    "hres": "H.Res.",
    "sres": "S.Res.",
}
# Statuses that mean passage by the House and enactment.
HOUSE_PASSED = (
    "PASS_OVER:HOUSE",
    "PASSED:BILL",
    "PASS_BACK:HOUSE",
    "VETOED:OVERRIDE_PASS_OVER:HOUSE",
    "ENACTED:VETO_OVERRIDE",
    "ENACTED:SIGNED",
)
ENACTED = ("ENACTED:SIGNED", "ENACTED:VETO_OVERRIDE")
# A prefix's letters may each carry a full stop, as in H.J.Res.
CITATION = r"(?i)\b(?:" + "|".join(r"\.?".join(k) + r"\.?" for k in sorted(BILL_TYPES, key=len, reverse=True)) + r")[\s.]*\d+\b"
URL = r"(?i)/(?:v3/)?bill/(\d+)/([a-z]+)/(\d+)"
BILL = "struct<congress:int,bill_type:string,bill_number:int>"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def bill_type(prefix) -> Column:
    """Citation prefix -> bill type, null when it is none."""
    return F.try_element_at(_map(BILL_TYPES), F.upper(F.regexp_replace(prefix, "[^A-Za-z]", "")))


def bill_label(kind, number) -> Column:
    label = F.coalesce(F.try_element_at(_map(BILL_LABELS), F.lower(kind)), F.upper(kind))
    return F.concat_ws(" ", label, number.cast("string"))


def bill(congress, kind, number) -> Column:
    return F.struct(
        congress.cast("int").alias("congress"), kind.alias("bill_type"), number.try_cast("int").alias("bill_number")
    )


def citations(text, congress) -> Column:
    """Bills cited in free text, in order -> array<struct<congress, bill_type, bill_number>>."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))
    found = F.transform(hits, lambda h: bill(congress, bill_type(h), F.regexp_extract(h, r"(\d+)$", 1)))
    return F.filter(found, lambda b: b["bill_type"].isNotNull())


def bill_from_url(url) -> Column:
    """Bill named by a URL path, null when there is none."""
    return F.when(
        F.coalesce(url.rlike(URL), F.lit(False)),
        bill(F.regexp_extract(url, URL, 1).cast("int"), F.lower(F.regexp_extract(url, URL, 2)), F.regexp_extract(url, URL, 3)),
    )


def related_bills(meeting_json, congress) -> Column:
    """Bills of a meeting: title citations, listed bills, generic items; first mention kept.

    The list may be an array or a single object, and fields have several spellings.
    A bill's URL is trusted before its fields.
    """
    title = citations(F.get_json_object(meeting_json, "$.title"), congress)
    one = "struct<url:string,congress:string,type:string,billType:string,bill_type:string,number:string,billNumber:string,bill_number:string>"
    item = "struct<url:string,name:string,title:string,citation:string,label:string,text:string,type:string>"

    def listed(paths: list[str], schema: str) -> Column:
        raw = F.coalesce(*[F.get_json_object(meeting_json, p) for p in paths])
        raw = F.replace(raw, F.lit('"URL"'), F.lit('"url"'))
        raw = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
        return F.coalesce(F.from_json(raw, f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>"))

    roots = ("$.relatedItems", "$.related_items")
    entries = listed([f"{r}.bills.{k}" for r in roots for k in ("bill", "item", "items")] + [f"{r}.bills" for r in roots], one)
    from_fields = F.transform(
        entries,
        lambda b: F.coalesce(
            bill_from_url(b["url"]),
            bill(
                F.coalesce(b["congress"].try_cast("int"), congress),
                bill_type(F.coalesce(b["type"], b["billType"], b["bill_type"])),
                F.trim(F.coalesce(b["number"], b["billNumber"], b["bill_number"])),
            ),
        ),
    )
    items = listed([f"{r}.{k}" for r in roots for k in ("item", "items")], item)
    from_items = F.flatten(
        F.transform(
            items,
            lambda i: F.concat(
                F.filter(F.array(bill_from_url(i["url"])), lambda b: b.isNotNull()),
                citations(F.concat_ws(" | ", i["name"], i["title"], i["citation"], i["label"], i["text"], i["type"]), congress),
            ),
        )
    )
    every = F.concat(title, from_fields, from_items)
    whole = F.filter(every, lambda b: b["bill_type"].isNotNull() & b["bill_number"].isNotNull())
    return F.array_distinct(whole)


def id_congress(bill_id) -> Column:
    return F.substring_index(bill_id, "-", -1).try_cast("int")


def id_label(bill_id) -> Column:
    """hr123-105 -> `105 H.R. 123`, for every bill type."""
    kind = F.regexp_extract(bill_id, r"^([a-z]+)", 1)
    number = F.regexp_extract(bill_id, r"^[a-z]+(\d+)", 1)
    return F.concat_ws(" ", F.substring_index(bill_id, "-", -1), bill_label(kind, number))


def passed(status, statuses) -> Column:
    return F.coalesce(status.isin(*statuses), F.lit(False)).cast("int")


def last_where(arr, cond) -> Column:
    """Last array element that meets the condition, null when none does."""
    return F.try_element_at(F.filter(arr, cond), F.lit(-1))


def member_ref(m) -> Column:
    """First available id of a member struct with its type."""
    bio = F.nullif(m["bioguide_id"], F.lit(""))
    return F.struct(
        F.coalesce(bio, F.nullif(m["thomas_id"], F.lit(""))).alias("member_id"),
        F.when(bio.isNotNull(), "bioguide").otherwise("thomas").alias("id_type"),
        m["party"].alias("party"),
    )


def count_where(arr, cond=None) -> Column:
    """Array size, or the number of elements meeting a condition; a null array counts 0."""
    return F.coalesce(F.size(F.filter(arr, cond) if cond else arr), F.lit(0)).cast("bigint")


def bipartisan(sponsor_party, cosponsors) -> Column:
    """Any cosponsor from the other major party; null without a sponsor party or a list."""
    other = F.when(sponsor_party == "Republican", "Democrat").otherwise("Republican")
    return F.when(
        sponsor_party.isNotNull() & cosponsors.isNotNull(), F.exists(cosponsors, lambda c: F.coalesce(c["party"] == other, F.lit(False)))
    )


def bipartisan_intensity(sponsor_party, majority, n_all, n_rep, n_dem) -> Column:
    """Minority share of sponsor and cosponsors; a sponsor of unknown party counts as minority."""
    minority_cos = F.when(majority == "Republican", n_dem).when(majority == "Democrat", n_rep)
    sponsor = (~F.coalesce(sponsor_party == majority, F.lit(False))).cast("int")
    return F.round((minority_cos + sponsor) / (n_all + 1), 3)


def moderation(sponsor_party, n_all, n_rep, n_dem) -> Column:
    """Share of cosponsors from the other party; 0 without cosponsors or a known party."""
    other = F.when(sponsor_party == "Democrat", n_rep).when(sponsor_party == "Republican", n_dem)
    return F.when(n_all == 0, 0.0).otherwise(F.coalesce(other / n_all, F.lit(0.0)))


def extremism(n_all, n_rep, n_dem) -> Column:
    return F.when(n_all > 0, (n_dem - n_rep) / n_all)


# Roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text) -> Column:
    """Roman numeral -> number; a digit before a larger one is subtracted."""
    digits = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.try_element_at(_map(ROMAN), c))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))

    def add(acc, v):
        twice = F.when(acc["prev"] < v, acc["prev"] * 2).otherwise(0)
        return F.struct((acc["total"] + v - twice).alias("total"), v.alias("prev"))

    return F.aggregate(digits, zero, add, lambda acc: acc["total"])


def page_count(text) -> Column:
    """`iv+120 p., 5-9` -> total pages: Roman front matter, single counts and ranges."""
    count = r"[0-9]+(?:,[0-9]{3})*"

    def number(part, pattern):
        return F.replace(F.regexp_extract(part, pattern, 1), F.lit(","), F.lit("")).try_cast("int")

    def pages(part):
        front = roman(F.regexp_extract(part, r"([A-Za-z]*)\+[0-9]", 1))
        start, end = number(part, f"^[^0-9]*({count})"), number(part, f"^[^0-9]*{count}-({count})")
        return F.coalesce(front + F.coalesce(end - start + 1, start), F.lit(0))

    return F.aggregate(F.transform(F.split(text, r",\s+"), pages), F.lit(0), lambda a, x: a + x)


def _without_pages(s) -> Column:
    """Cut a trailing page reference."""
    return F.when(F.instr(s, ", p.") > 0, F.substring_index(s, ", p.", 1)).otherwise(F.substring_index(s, "p.", 1))


def role_and_affiliation(text) -> Column:
    """`Director, Agency of X, p. 12` -> struct<role, affiliation>, page reference removed."""
    has_role = F.instr(text, ",") > 0
    role = F.when(has_role, strip(F.substring_index(text, ",", 1)))
    rest = F.when(has_role, F.regexp_replace(text, r"(?s)^[^,]*,", "")).otherwise(text)
    return F.struct(role.alias("role"), strip(_without_pages(strip(rest))).alias("affiliation"))


def committee_and_sub(source) -> Column:
    """`Subcommittee on A. Committee on B` -> struct<committee, subcommittee>."""
    is_sub = source.contains("Subcommittee") & source.contains(" Committee")
    second = F.get(F.split(source, " Committee"), F.lit(1))
    return F.struct(
        F.when(is_sub, F.concat(F.lit("Committee"), second)).otherwise(source).alias("committee"),
        F.when(is_sub, F.substring_index(source, " Committee", 1)).alias("subcommittee"),
    )


def id_chamber(hearing_id) -> Column:
    """House / Senate / Unknown from an id such as hhrg1-105."""
    prefix = F.regexp_extract(F.lower(hearing_id), r"^([a-z]+)", 1)
    return F.when(prefix == "hhrg", "House").when(prefix == "shrg", "Senate").otherwise("Unknown")


def named_chamber(text) -> Column:
    """House, Senate, Joint or Other from free text; null stays null."""
    low = F.lower(text)
    house, senate = low.contains("house"), low.contains("senate")
    return (
        F.when(text.isNull(), None)
        .when(house & ~senate, "House")
        .when(senate & ~house, "Senate")
        .when(low.contains("joint"), "Joint")
        .otherwise("Other")
    )


# ---- multi-label fields -------------------------------------------------------------------


def star_labels(text) -> Column:
    """`Causal ***** Monetary.` -> array of labels, letters only."""
    return F.filter(
        F.transform(F.split(text, r"\*{5}"), lambda s: F.regexp_replace(s, "[^a-zA-Z]", "")), lambda s: s != ""
    )


def comma_labels(text) -> Column:
    """`Causal, Mone tary.` -> array of lower-case labels without blanks and full stops."""
    clean = F.lower(F.regexp_replace(text, r"[ .]", ""))
    return F.filter(F.split(clean, ","), lambda s: s != "")


def one_hot(labels, names: list[str], prefix: str = "is_") -> list[Column]:
    return [F.coalesce(F.array_contains(labels, n), F.lit(False)).cast("int").alias(f"{prefix}{n.lower()}") for n in names]


def same_set(a, b) -> Column:
    """1 when two comma lists hold the same items, order and case aside; null reads as empty."""

    def items(c):
        return F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(strip(x)))))

    return (items(a) == items(b)).cast("int")


# ---- model replies --------------------------------------------------------------------------

# Section headings of a labelling reply.
SECTIONS = ("*** EMPIRICAL BINARY ***", "*** EMPIRICAL EVIDENCE QUOTES ***", "*** EMPIRICAL EVIDENCE CATEGORY ***")


def reply_sections(text) -> Column:
    """Sectioned reply -> struct<binary, quotes, categories>."""
    first, second, third = SECTIONS
    binary = strip(F.substring_index(F.substring_index(text, second, 1), first, -1))
    quotes = strip(F.substring_index(F.substring_index(text, third, 1), second, -1))
    cats = strip(F.substring_index(text, third, -1))
    return F.struct(
        binary.alias("binary"), F.split(quotes, r" \*{5} ").alias("quotes"), F.split(cats, r" \*{5} ").alias("categories")
    )


def yes_no(text) -> Column:
    return F.when(F.lower(strip(text)).isin("yes", "y"), 1).otherwise(0)


def positive_probability(text) -> Column:
    """`[0.99 0.01]` -> 0.01."""
    parts = F.split(squeeze(F.regexp_replace(text, r"[\[\]]", "")), " ")
    return F.get(parts, F.lit(1)).try_cast("double")


def prompt(before, target, after) -> Column:
    return F.concat(
        F.lit("<context_before> "), before, F.lit(" </context_before> <target_sentence> "), target,
        F.lit(" </target_sentence> <context_after> "), after, F.lit(" </context_after>"),
    )
