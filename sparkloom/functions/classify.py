"""First-match classifications of paths, changes, jobs, reviews and repositories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a plan does with a file, by its suffix or name.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rb": "ruby"}
EXCLUDED = ("png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "zip", "tar", "gz", "7z", "rar", "pdf", "exe", "dll", "so", "dylib", "pyc", "pyo", "pyd", "lock", "map")
LOCKS = ("package-lock.json", "uv.lock", "poetry.lock", "yarn.lock")
MARKDOWN = ("md", "markdown", "mdown")
CONFIG = ("yaml", "yml", "json", "toml", "ini", "conf")
# Patterns that tell what a change touches, in the order in which they are tried.
ROUTE = r"@\w+(?:\.\w+)*\.(?:get|post|put|patch|delete)\s*\(|(?:paths:|openapi:)"
TABLE = r"\b(?:Column|ForeignKey|create_table|alter_column|CREATE TABLE|ALTER TABLE)\b"
DATA = r"\b(?:session|db)\.(?:query|execute|add|commit|delete)\s*\(|\b(?:SELECT|INSERT INTO|UPDATE)\b"
FLOW = r"\b(?:add_edge|add_conditional_edges|processing_status|set_entry_point)\b"
MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "go.mod", "Cargo.toml")
IMPORT = r"(?m)^\s*(?:from\s+\S+\s+import|import\s+\S+)"
SETTING_FILES = (".yaml", ".yml", ".toml", ".ini", ".env", ".json")
SETTING = r"\b(?:getenv|environ)\b"
UNIT = r"(?m)^\s*(?:class|(?:async )?def)\s+"


def first_match(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name without its dot; a name's leading dot starts none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, suffix(path))


def file_plan(path: Column) -> Column:
    """(action, strategy, language) of a repository file; the order of the cases decides."""
    end, name = suffix(path), F.lower(base_name(path))
    plan = lambda action, strategy, lang: F.struct(F.lit(action).alias("action"), F.lit(strategy).alias("strategy"), lang.cast("string").alias("language"))
    return first_match(
        [
            (end.isin(*EXCLUDED) | name.isin(*LOCKS), plan("EXCLUDE", "FALLBACK", F.lit(None))),
            (end.isin(*MARKDOWN), plan("INCLUDE", "MARKDOWN_SECTION", F.lit("markdown"))),
            (end == "proto", plan("INCLUDE", "PROTO_MESSAGE", F.lit("proto"))),
            (name.contains("openapi") | name.contains("swagger"), plan("INCLUDE", "OPENAPI_OPERATION", end)),
            (end.isin(*LANGUAGES), plan("INCLUDE", "SYMBOL", language(path))),
            (end.isin(*CONFIG), plan("INCLUDE", "CONFIG_SECTION", end)),
        ],
        plan("LOW_PRIORITY", "WHOLE_FILE", F.lit(None)),
    )


#: A place between an ASCII word character and another, as RE2 has it, whatever Java's version takes for \b.
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def delta_kind(path: Column, before: Column, after: Column, route: Column | None = None, ascii_words: bool = False) -> Column:
    """What a change touches, by its text on both sides; a change inside a declared route is an API one. Lines end
    at \\n. Words and spaces are Unicode's as in Python's re, or with ascii_words ASCII's as in RE2."""
    text = F.concat(F.coalesce(before, F.lit("")), F.lit("\n"), F.coalesce(after, F.lit("")))
    plain = lambda pattern: "(?d)" + pattern.replace(r"\b", ASCII_EDGE).replace(r"\s", r"[\t\n\f\r ]").replace(r"\S", r"[^\t\n\f\r ]")
    has = lambda pattern: text.rlike(plain(pattern) if ascii_words else f"(?Ud){pattern}")
    ends = lambda: path.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in SETTING_FILES) + ")$")
    cases = [
        (has(ROUTE), "API"),
        (has(TABLE), "SCHEMA"),
        (has(DATA), "DATA_ACCESS"),
        (has(FLOW), "WORKFLOW"),
        (base_name(path).isin(*MANIFESTS) | has(IMPORT), "DEPENDENCY"),
        (ends() | has(SETTING), "CONFIGURATION"),
        (has(UNIT), "COMPONENT"),
    ]
    return first_match(([(F.coalesce(route, F.lit(False)), "API")] if route is not None else []) + cases, "OTHER")


def valid_path(path: Column) -> Column:
    """Relative, without parent steps, back slashes or empty parts."""
    return ~path.rlike(r"^/|\\|(^|/)\.\.?(/|$)|//") & (F.length(path) > 0)


def backoff(attempts: Column, base: int, most: int, cap: int) -> Column:
    """min(most, base * 2 ** min(attempts, cap)) seconds."""
    return F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), F.least(attempts, F.lit(cap))))


def capability(user: Column, owners: Column, admin: Column, owner: Column, bound: Column, installation: Column) -> Column:
    """Why a user may monitor a repository or not. owners are the users of all records of its names; owner and
    bound are those of the tracked record. Only a foreign owner or another installation refuse; a missing
    record does not, and an unknown permission stays unknown."""
    foreign = F.exists(owners, lambda o: o.isNotNull() & (o != "") & (o != user))
    moved = (owner == user) & ~bound.eqNullSafe(installation)
    return first_match([(F.coalesce(foreign, F.lit(False)), "owned_by_another_user"), (admin.isNull(), "permission_unknown"), (~admin, "github_admin_required"), (F.coalesce(moved, F.lit(False)), "installation_binding_mismatch")], "allowed")


def monitoring(reason: Column, status: Column) -> Column:
    """(can_enable, can_retry): null where the permission is not known."""
    allowed = F.when(reason == "allowed", True).when(reason == "permission_unknown", F.lit(None).cast("boolean")).otherwise(False)
    can = lambda *states: F.when(status.isin(*states), allowed).otherwise(False)
    return F.struct(can("IDLE", "NOT_INDEXED").alias("can_enable"), can("FAILED").alias("can_retry"))


def review_status(stale: Column, evaluated: Column, outcome: Column, conflicts: Column, review: Column, complete: Column, status: Column) -> Column:
    """Staleness first, then a missing evaluation, conflicts, review, a clean outcome, running, failure."""
    return first_match(
        [
            (stale, "STALE"),
            (~evaluated, "NOT_EVALUATED"),
            ((conflicts > 0) | (outcome == "CONFLICTS_FOUND"), "CONFLICTS"),
            ((review > 0) | (outcome == "REVIEW_REQUIRED"), "NEEDS_REVIEW"),
            ((outcome == "NO_CONFLICTS_FOUND") & complete, "CLEAN"),
            (outcome == "NO_CONFLICTS_FOUND", "CLEAN_INCOMPLETE"),
            (status == "QUEUED", "QUEUED"),
            (status == "RUNNING", "EVALUATING"),
            (status == "FAILED", "UNAVAILABLE"),
        ],
        "NOT_EVALUATED",
    )


def verified_attribution(before: Column, head: Column, target: Column, claimed: Column, changed: Column) -> Column:
    """The claimed attribution if behaviours at merge base, head and target base bear it out, else UNKNOWN.
    Behaviours are SATISFIES, VIOLATES, NOT_APPLICABLE or UNKNOWN."""
    fine = lambda c: c.isin("SATISFIES", "NOT_APPLICABLE")
    still = (before == "VIOLATES") & (head == "VIOLATES") & (target != "UNKNOWN")
    holds = first_match(
        [
            (claimed == "INTRODUCED", fine(before) & (head == "VIOLATES") & fine(target)),
            (claimed.isin("WORSENED", "PRE_EXISTING"), still),
            (claimed == "RESOLVED", (before == "VIOLATES") & (head == "SATISFIES")),
            (claimed == "UNCHANGED", (before == head) & (head != "UNKNOWN")),
        ],
        F.lit(False),
    )
    return F.when(holds & (target != "UNKNOWN") & changed, claimed).otherwise("UNKNOWN")


def check_conclusion(outcome: Column, conflicts: Column, gaps: Column) -> Column:
    """Conclusion of a published check: what was not evaluated asks for action, a supported conflict fails,
    any gap (incomplete run or scope, limitation, rejected, open or advisory finding) is neutral."""
    missing = outcome.isNull() | (outcome == "NOT_EVALUATED")
    return first_match([(missing, "action_required"), (conflicts > 0, "failure"), (gaps | (outcome != "NO_CONFLICTS_FOUND"), "neutral")], "success")


def evaluation_outcome(run: Column, conflicts: Column, partial: Column) -> Column:
    """Outcome of an evaluation: supported conflicts, nothing proposed, gaps, or clean."""
    return first_match([(conflicts > 0, "CONFLICTS_FOUND"), (~run, "NOT_EVALUATED"), (partial, "REVIEW_REQUIRED")], "NO_CONFLICTS_FOUND")


def repository_state(tracked: Column, status: Column, reason: Column) -> Column:
    """State of a listed repository: the life cycle of a tracked one comes before restrictions."""
    held = tracked & status.isin("COMPLETED", "INDEXING", "FAILED")
    known = F.create_map(*[F.lit(x) for x in ("COMPLETED", "ready", "INDEXING", "indexing", "FAILED", "failed", "IDLE", "available", "NOT_INDEXED", "available")])
    named = F.coalesce(F.try_element_at(known, status), F.lit("unknown"))
    barred = reason.isin("owned_by_another_user", "installation_binding_mismatch") | ((reason == "github_admin_required") & status.isin("IDLE", "NOT_INDEXED", "FAILED"))
    return first_match([(held, named), (F.coalesce(barred, F.lit(False)), "restricted"), (~tracked, F.when(status == "NOT_INDEXED", "available").otherwise("unknown"))], named)


def repository_action(tracked: Column, status: Column, reason: Column, admin: Column, can: Column) -> Column:
    """enable, retry or null: only an administrator who is allowed gets one."""
    may = F.coalesce(admin & (reason == "allowed"), F.lit(False))
    enable = status.isin("IDLE", "NOT_INDEXED") & F.coalesce(can["can_enable"], F.lit(False))
    retry = tracked & (status == "FAILED") & F.coalesce(can["can_retry"], F.lit(False))
    return F.when(may & enable, "enable").when(may & retry, "retry")


def channel_state(raw: Column, gaps: Column, found: Column, omitted: Column) -> Column:
    """State of a retrieval channel: a gap in its index cuts what was found, or makes it unavailable where
    nothing was; a query that was left out cuts a channel that is otherwise whole."""
    whole = raw.isin("READY", "EMPTY")
    return first_match([(whole & gaps & (found > 0), "TRUNCATED"), (whole & gaps, "UNAVAILABLE"), (whole & omitted, "TRUNCATED")], raw)


def path_actions(status: Column, old: Column, new: Column) -> Column:
    """(path, action) rows of a changed path by its letter: a renamed one is deleted and added."""
    row = lambda path, action: F.struct(path.alias("path"), F.lit(action).alias("action"))
    return first_match([(status == "R", F.array(row(old, "DELETE"), row(new, "ADD"))), (status == "D", F.array(row(old, "DELETE"))), (status == "A", F.array(row(new, "ADD")))], F.array(row(new, "MODIFY")))
