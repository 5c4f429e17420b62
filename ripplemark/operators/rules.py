"""Risk rules: what kinds of risk a change carries, told from the old and the new facts of a symbol.

Every rule is a condition on one row, so all of them are one projection: no join, no shuffle, and a root's rows come out
together. Rules add up; each (group, reason) counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.text import test_path
from ripplemark.operators.changes import changed_tokens

# The tokens whose coming or going marks a risk.
RAW_POINTER = ["new", "delete", "malloc", "calloc", "realloc", "free", "nullptr", "NULL", "unique_ptr", "shared_ptr", "weak_ptr", "make_unique", "make_shared", "release", "auto_ptr"]
MOVE = ["move", "forward"]
MUTEX = [
    "mutex", "recursive_mutex", "shared_mutex", "timed_mutex", "recursive_timed_mutex", "shared_timed_mutex", "lock_guard", "unique_lock", "scoped_lock", "shared_lock",
    "condition_variable", "condition_variable_any", "lock", "unlock", "try_lock", "notify_one", "notify_all", "wait", "wait_for", "wait_until", "call_once", "once_flag",
    "pthread_mutex_lock", "pthread_mutex_unlock", "pthread_mutex_t", "pthread_cond_wait", "pthread_cond_signal", "thread", "async", "future", "promise", "pthread_create", "detach", "join",
]
ATOMIC = [
    "atomic", "atomic_flag", "atomic_bool", "atomic_int", "memory_order", "memory_order_relaxed", "memory_order_acquire", "memory_order_release", "memory_order_acq_rel", "memory_order_seq_cst",
    "volatile", "fetch_add", "fetch_sub", "compare_exchange_weak", "compare_exchange_strong", "exchange", "load", "store", "thread_local",
]
ACQUIRE = ["lock_guard", "unique_lock", "scoped_lock", "shared_lock", "lock", "pthread_mutex_lock"]
EXCEPTION = ["throw", "try", "catch", "rethrow_exception", "current_exception", "exception_ptr", "terminate"]
DEBUG = ["NDEBUG", "_DEBUG", "DEBUG", "assert", "static_assert"]
LOGIC = [
    "if", "else", "switch", "case", "default", "return", "for", "while", "do", "break", "continue", "goto", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "?", ":",
    "+", "-", "*", "/", "%", "++", "--", "+=", "-=", "<<", ">>", "&", "|", "^", "~", "true", "false",
]
# Names of a project's own lock types, and numbers.
LOCK_TYPE = r"(?i)^\w*(mutex|locker|spinlock|semaphore|critical_?section|guard_?lock)\w*$"
LOCK_SUFFIX = r"^\w*Lock$"
NUMBER = r"^-?(0x[0-9a-fA-F]+|[0-9]+(\.[0-9]+)?)[uUlLfF]*$"
TEST_SYMBOL = r"(_Test$|_Test::|^gtest_|::gtest_|AddToRegistry$|gtest_registering_dummy_)"

HEADER = r"\.(h|hh|hpp|hxx|ipp|inl)$"
BUILD_FILE = r"(^|/)CMakeLists\.txt$|\.cmake$"
STRINGS = "cast(array() as array<string>)"

#: What a row of changes may say, with what is meant where the column is not there.
COLUMNS = {
    "name": "string", "kind": "string", "change_kind": "string", "file": "string",
    "old_tokens": "array<string>", "new_tokens": "array<string>", "old_decl": "array<string>", "new_decl": "array<string>",
    "old_bases": "array<string>", "new_bases": "array<string>", "old_virtuals": "array<string>", "new_virtuals": "array<string>",
    "old_fields": "array<struct<name:string,type:string>>", "new_fields": "array<struct<name:string,type:string>>",
    "old_noexcept": "string", "new_noexcept": "string", "is_inline": "boolean", "is_log": "boolean",
    "conditions": "array<string>", "directives": "array<string>", "shapes": "array<string>",
}


def lock_sequence(tokens: Column) -> Column:
    """What is locked, in order: the first name in the brackets behind each token that acquires a lock."""

    def locked(t: Column, i: Column) -> Column:
        opened = F.array_position(F.slice(tokens, i + 2, 11), F.lit("("))
        rest = F.slice(tokens, i + 2 + opened.cast("int"), 64)
        return F.when(t.isin(*ACQUIRE) & (opened > 0), F.get(F.filter(rest, lambda x: x.rlike("^[A-Za-z_]")), F.lit(0)))

    return F.filter(F.transform(tokens, locked), lambda x: x.isNotNull())


def signature(decl: Column) -> tuple[Column, Column]:
    """(pointer parts, reference parts) of a declaration: return type and parameters without their names. A const char
    pointer and a const reference are ways to pass a value and do not count."""
    s = F.array_join(decl, " ")
    for _ in range(3):
        s = F.regexp_replace(s, "<[^<>]*>", "")
    inside = F.regexp_extract(s, r"^[^(]*\((.*)\)[^()]*$", 1)
    parts = F.concat(F.array(F.regexp_extract(s, r"^([^(]*)\(", 1)), F.split(inside, ","))
    kinds = F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.btrim(p), r"[A-Za-z_]\w*$", "")))
    has = lambda p, w: p.rlike(rf"\b{w}\b")
    return F.filter(kinds, lambda p: p.contains("*") & ~(has(p, "char") & has(p, "const"))), F.filter(kinds, lambda p: p.contains("&") & ~has(p, "const"))


def _rules() -> list[tuple[Column, str, str]]:
    c = F.col
    both = c("old_tokens").isNotNull() & c("new_tokens").isNotNull() & (c("change_kind") == "modified")
    differ = lambda x: both & ~c(f"old_{x}").eqNullSafe(c(f"new_{x}"))
    hit = lambda ts: F.arrays_overlap(c("_delta"), F.lit(ts))
    function = c("kind").isin("function", "method")
    header = F.coalesce(c("file").rlike(HEADER), F.lit(False))
    fields = differ("fields")
    types = F.array_join(F.transform(F.concat(F.coalesce(c("old_fields"), F.array()), F.coalesce(c("new_fields"), F.array())), lambda f: f["type"]), " ")
    (old_ptr, old_ref), (new_ptr, new_ref) = signature(c("old_decl")), signature(c("new_decl"))
    sequences = lock_sequence(c("old_tokens")), lock_sequence(c("new_tokens"))
    shape = lambda *s: F.arrays_overlap(c("shapes"), F.lit(list(s)))
    signature_changed = (function & both & ~c("old_decl").eqNullSafe(c("new_decl"))) | ((c("change_kind") == "removed") & (c("kind") != "file"))
    members = (c("kind").isin("class", "struct") & (fields | differ("virtuals") | differ("bases"))) | ((c("kind") == "enum") & differ("tokens"))
    inline = function & header & c("is_inline") & differ("tokens") & c("old_decl").eqNullSafe(c("new_decl"))
    logic = hit(LOGIC) | F.exists("_delta", lambda t: t.rlike(NUMBER)) | (function & (differ("tokens") | (c("change_kind") == "added"))) | (c("change_kind") == "explicit")
    guard = shape("removed_guard")
    return [
        (c("file").rlike(BUILD_FILE) & (c("kind") == "file"), "build_config", "target"),
        ((c("kind") == "macro") | (F.size("conditions") > 0) | F.exists("directives", lambda d: ~d.rlike(r"^\s*#\s*include\b")), "build_config", "macro"),
        (hit(DEBUG), "build_config", "debug_release"),
        (members, "abi_layout", "member_change"),
        (signature_changed, "abi_layout", "signature_change"),
        (inline, "abi_layout", "inline_change"),
        (header & (c("change_kind") != "explicit") & ~(members | signature_changed | inline), "abi_layout", "header_change"),
        (hit(RAW_POINTER) | (both & (old_ptr != new_ptr)) | (fields & types.contains("*")), "ownership_lifetime", "raw_pointer"),
        ((both & (old_ref != new_ref)) | (fields & F.regexp_replace(types, "&&", "").contains("&")), "ownership_lifetime", "reference"),
        (hit(MOVE) | F.array_contains(c("_decl_delta"), "&&"), "ownership_lifetime", "move_semantics"),
        (
            hit(MUTEX) | F.exists("_delta", lambda t: (t.rlike(LOCK_TYPE) | t.rlike(LOCK_SUFFIX)) & ~t.isin(*ATOMIC)) | shape("lock_removed", "lock_added") | (fields & types.rlike(r"\bmutex")),
            "thread_safety", "mutex",
        ),
        (hit(ATOMIC) | (fields & types.rlike(r"\batomic") & ~types.rlike("mutex")), "thread_safety", "atomic"),
        (both & (sequences[0] != sequences[1]) & (F.size(sequences[1]) > 1) & (F.array_sort(sequences[0]) == F.array_sort(sequences[1])), "thread_safety", "lock_order"),
        (differ("noexcept") | F.array_contains(c("_delta"), "noexcept"), "exception_safety", "noexcept_change"),
        (hit(EXCEPTION), "exception_safety", "throw_added"),
        (guard, "logic", "removed_guard"),
        (logic & ~guard, "logic", ""),
    ]


def risk_rows(changes: DataFrame) -> DataFrame:
    """(root, risk_group, sub_reason): every row is one reason a change is risky; '' stands for no reason in particular.

    changes: root and any of COLUMNS; a null or absent list of old or new facts means that the symbol was not there, null
    flags are false. A change of test code or of logging alone has that one reason; a build file only those of the build;
    a root no rule matches is a logic change."""
    have = [F.col(n).cast(t).alias(n) if n in changes.columns else F.lit(None).cast(t).alias(n) for n, t in COLUMNS.items()]
    empty = F.expr(STRINGS)
    row = changes.select("root", *have)
    for n in ("conditions", "directives", "shapes"):
        row = row.withColumn(n, F.coalesce(n, empty))
    for n in ("is_inline", "is_log"):
        row = row.withColumn(n, F.coalesce(n, F.lit(False)))
    row = row.withColumns({"_delta": changed_tokens(F.col("old_tokens"), F.col("new_tokens")), "_decl_delta": changed_tokens(F.col("old_decl"), F.col("new_decl"))})
    reason = lambda g, s: F.struct(F.lit(g).alias("g"), F.lit(s).alias("s"))
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), reason(g, s)) for c, g, s in _rules()]), lambda x: x.isNotNull())
    build = F.coalesce(F.col("file").rlike(BUILD_FILE) & (F.col("kind") == "file"), F.lit(False))
    test = F.coalesce(test_path(F.col("file")), F.lit(False)) | F.coalesce(F.col("name").rlike(TEST_SYMBOL), F.lit(False))
    rows = (
        F.when(test, F.array(reason("logic", "test_code")))
        .when(F.col("is_log"), F.array(reason("logic", "logging")))
        .when(build, F.filter(found, lambda x: x["g"] == "build_config"))
        .when(F.size(found) == 0, F.array(reason("logic", "")))
        .otherwise(found)
    )
    return row.select("root", F.explode(rows).alias("r")).select("root", F.col("r.g").alias("risk_group"), F.col("r.s").alias("sub_reason"))


def changes_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of changes of two versions of the facts: usr, file, kind, tokens, decl_tokens, bases, is_virtual,
    noexcept_spec. Of the shapes of an edit those that tokens alone can tell: fewer conditions than before, and fewer or
    more tokens that acquire a lock. Whether a body is inline is told by its being in a header."""
    o, n = old.alias("o"), new.alias("n")
    was, now = F.col("o.usr").isNotNull(), F.col("n.usr").isNotNull()
    j = o.join(n, F.col("o.usr") == F.col("n.usr"), "full").where(~(was & now) | ~F.col("o.tokens").eqNullSafe(F.col("n.tokens")) | ~F.col("o.decl_tokens").eqNullSafe(F.col("n.decl_tokens")))
    both = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    count = lambda s, ts: F.size(F.filter(F.col(f"{s}.tokens"), lambda t: t.isin(*ts)))
    virtual = lambda s, there: F.when(there, F.when(F.col(f"{s}.is_virtual"), F.array(F.lit("virtual"))).otherwise(F.expr(STRINGS)))
    shapes = [(count("o", ["if"]) > count("n", ["if"]), "removed_guard"), (count("o", ACQUIRE) > count("n", ACQUIRE), "lock_removed"), (count("o", ACQUIRE) < count("n", ACQUIRE), "lock_added")]
    return j.select(
        both("usr").alias("root"), both("name").alias("name"), both("kind").alias("kind"), both("file").alias("file"),
        F.when(~was, "added").when(~now, "removed").otherwise("modified").alias("change_kind"),
        F.col("o.tokens").alias("old_tokens"), F.col("n.tokens").alias("new_tokens"), F.col("o.decl_tokens").alias("old_decl"), F.col("n.decl_tokens").alias("new_decl"),
        F.col("o.bases").alias("old_bases"), F.col("n.bases").alias("new_bases"), virtual("o", was).alias("old_virtuals"), virtual("n", now).alias("new_virtuals"),
        F.col("o.noexcept_spec").alias("old_noexcept"), F.col("n.noexcept_spec").alias("new_noexcept"), both("file").rlike(HEADER).alias("is_inline"),
        F.when(was & now, F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in shapes]), lambda x: x.isNotNull())).alias("shapes"),
    )


# The groups of foreign calls, most severe first.
EXTERNAL_ORDER = ["exception_safety", "ownership_lifetime", "thread_safety", "logic"]


def external_risk(calls: DataFrame) -> DataFrame:
    """(root, risk_group, sub_reason): one row for each root that calls foreign code, of the most severe group its callees
    have a signal of. calls: root and the columns of callee_facts."""
    signals = callee_signals()
    rows = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(g)) for c, g, _ in signals]), lambda x: x.isNotNull())
    place = F.array_position(F.lit(EXTERNAL_ORDER), F.col("g"))
    return calls.select("root", F.explode(rows).alias("g")).groupBy("root").agg(F.min_by("g", place).alias("risk_group")).select("root", "risk_group", F.lit("external_call").alias("sub_reason"))


def callee_facts(decl: Column, noexcept: Column, is_const: Column | None = None) -> dict[str, Column]:
    """What a declaration tells about calling it: result (pointer, status or none), whether it may throw, how many
    parameters it writes through, takes as callbacks, or as a buffer with its length."""
    s = F.array_join(decl, " ")
    inside = F.regexp_extract(s, r"^[^(]*\((.*)\)[^()]*$", 1)
    params = F.filter(F.split(inside, ","), lambda p: F.btrim(p) != "")
    result = F.regexp_extract(s, r"^(.*?)[A-Za-z_~]\w*\s*\(", 1)
    const = F.coalesce(is_const, F.lit(False)) if is_const is not None else s.rlike(r"\)\s*const\b")
    writes = F.size(F.filter(params, lambda p: p.rlike("[*&]") & ~p.rlike(r"\bconst\b|&\s*&")))
    return {
        "result": F.when(result.contains("*"), "pointer").when(result.rlike(r"\b(bool|int|long|ssize_t|errno_t|\w*[Ss]tatus\w*|\w*[Ee]rror\w*|optional)\b"), "status").otherwise("none"),
        "may_throw": ~F.coalesce(noexcept, F.lit("")).rlike("noexcept|throw") & ~const,
        "out_params": F.when(const, 0).otherwise(writes),
        "callbacks": F.size(F.filter(params, lambda p: p.rlike(r"\b(function|\w*[Cc]allback\w*|\w*[Hh]andler\w*)\b|\(\s*\*"))),
        "buffers": F.when(const, 0).otherwise(F.size(F.filter(F.transform(params, lambda p, i: p.rlike(r"\*|\bspan\b") & F.coalesce(F.get(params, i + 1).rlike(r"\b(size_t|int|unsigned|uint\d+_t)\b"), F.lit(False))), lambda x: x))),
    }


def callee_signals() -> list[tuple[Column, str, str]]:
    """(condition on callee_facts, risk group, signal)."""
    c = F.col
    none = (c("result") == "none") & (c("out_params") == 0) & (c("callbacks") == 0) & (c("buffers") == 0) & ~c("may_throw")
    return [
        (c("result") == "pointer", "ownership_lifetime", "returns a pointer"),
        (c("result") == "status", "logic", "returns a status"),
        (c("may_throw"), "exception_safety", "may throw"),
        (c("out_params") > 0, "ownership_lifetime", "writes through a parameter"),
        (c("callbacks") > 0, "thread_safety", "takes a callback"),
        (c("buffers") > 0, "logic", "takes a buffer and its length"),
        (none, "logic", "no contract in sight"),
    ]

