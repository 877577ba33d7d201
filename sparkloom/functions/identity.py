"""Content-addressed ids and name normalisation, as Column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """sha256 of the UTF-8 text, lowercase hex."""
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """Digest of the parts as one compact JSON array of strings."""
    return digest(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def fingerprint(**fields: Column) -> Column:
    """Digest of the fields as compact JSON with sorted keys; nulls are kept."""
    return digest(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


def keyed_id(separator: str, *parts: Column) -> Column:
    """Digest of the parts joined by a separator: chunk, decision and revision keys."""
    return digest(F.concat_ws(separator, *[p.cast("string") for p in parts]))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Full case folding beyond lower case, as the runtime's own tables give it: characters that become one
    other, what they become, and characters that become several."""
    every = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and c.casefold() != c]
    single = [c for c in every if len(c.casefold()) == 1]
    return "".join(single), "".join(c.casefold() for c in single), tuple((c, c.casefold()) for c in every if len(c.casefold()) > 1)


def folded(text: Column) -> Column:
    """Full Unicode case folding; texts of plain letters only pay for lower case."""
    low = F.lower(text)
    before, after, longer = _foldings()
    rare = "".join(c for c, _ in longer)
    translated = F.translate(low, before, after)
    table = F.create_map(*[F.lit(x) for pair in longer for x in pair])
    full = F.array_join(F.transform(F.split(translated, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(~low.rlike("[^\\x00-\\x7f]"), low).when(low.rlike(f"[{rare}]"), full).otherwise(translated)


def entity_id(scope: Column, label: Column, name: Column) -> Column:
    """Canonical entity id; null where label or name is blank."""
    label, name = folded(F.trim(label)), folded(F.trim(name))
    return F.when((label != "") & (name != ""), keyed_id("|", scope, label, name))


def community_id(members: Column) -> Column:
    """`comm_` and 12 hex digits of the digest of the sorted distinct members."""
    return F.concat(F.lit("comm_"), F.substring(digest(F.array_join(F.array_sort(F.array_distinct(members)), "|")), 1, 12))


def relationship_type(text: Column) -> Column:
    """Upper-case identifier of a relationship: RELATED_TO when nothing is left, R_ before a digit."""
    plain = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9_]", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(plain == "", "RELATED_TO").when(plain.rlike("^[0-9]"), F.concat(F.lit("R_"), plain)).otherwise(plain)


def squeezed(name: Column) -> Column:
    """A name without white space, underscores and hyphens, folded."""
    return folded(F.regexp_replace(name, r"[\s_\-]+", ""))


#: Labels that fit every other label.
GENERIC = ("component", "entity", "module", "architecturecomponent")


def labels_agree(a: Column, b: Column) -> Column:
    """Labels are compatible if one is missing or generic, or both are equal but for case."""
    x, y = folded(F.trim(a)), folded(F.trim(b))
    return F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("") | (x == y) | x.isin(*GENERIC) | y.isin(*GENERIC)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    """Id of a drawn edge, empty for self-loops and missing ends; a prefix `entity:` is dropped first."""
    bare = lambda c: F.regexp_replace(c, "^entity:", "")
    ok = source.isNotNull() & target.isNotNull() & (bare(source) != bare(target))
    return F.when(ok, F.concat_ws(":", F.lit("edge"), bare(source), kind, bare(target))).otherwise("")


def node_id(entity: Column) -> Column:
    """Id of a drawn entity; a prefix `entity:` is dropped first, empty where there is none."""
    bare = F.regexp_replace(entity, "^entity:", "")
    return F.when(F.coalesce(bare, F.lit("")) != "", F.concat(F.lit("entity:"), bare)).otherwise("")
