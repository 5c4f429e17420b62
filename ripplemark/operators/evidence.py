"""How sure an analysis is, and where a case must be checked: flags for what a static graph cannot show, and reasons why a
risk only shows when the code runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.text import IDENT, strip_comments
from ripplemark.operators.ranking import first_k

# Relations by which a template is used, names that load or dispatch code, macros of a debug build.
TEMPLATE_USES = ["instantiate", "call", "uses_type", "inherit_override"]
DYNAMIC = ["dlopen", "dlsym", "GetProcAddress", "LoadLibrary", "invokeMethod"]
DEBUG_MACROS = ["NDEBUG", "_DEBUG", "DEBUG"]
#: Flags after which a root gets no cases: what it affects is not known at all.
INSTEAD_OF_CASES = ["uninstantiated_template", "di_config_routing"]
#: Flags that say a case is routed at run time.
RUNTIME_FLAGS = ["dynamic_runtime_dependency", "di_config_routing", "build_config_incomplete_macro"]


def _flag(df: DataFrame, category: str, why: str, detail: Column | None = None) -> DataFrame:
    return df.select("root", F.lit(category).alias("category"), F.lit(why).alias("why"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def template_flags(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Templates that are still there and that nothing instantiates, calls, names or derives from.

    roots: root, change_kind, is_template; edges: dependency, dependent, relation."""
    used = edges.where(F.col("relation").isin(*TEMPLATE_USES) & F.col("dependent").isNotNull()).select(F.col("dependency").alias("root")).distinct()
    return _flag(roots.where("is_template and change_kind <> 'removed'").join(used, "root", "left_anti"), "uninstantiated_template", "no use in sight")


def routing_flags(roots: DataFrame, groups: DataFrame, calls: DataFrame) -> DataFrame:
    """Virtual or overriding methods of which neither they nor what they override is called.

    roots: root, kind, is_virtual; groups: method, member (each method of an override group with each); calls: callee."""
    called = calls.select(F.col("callee").alias("member")).distinct()
    mine = roots.where("kind = 'method'").join(groups.select(F.col("method").alias("root"), "member"), "root", "left").where("is_virtual or member is not null")
    members = mine.select("root", F.explode(F.array_distinct(F.array("root", F.coalesce("member", "root")))).alias("member"))
    live = members.join(called, "member", "left_semi").select("root").distinct()
    return _flag(mine.select("root").distinct().join(live, "root", "left_anti"), "di_config_routing", "no caller in sight")


def address_flags(roots: DataFrame, taken: DataFrame) -> DataFrame:
    """Functions whose address is taken: the first place. roots: root, kind; taken: root, file, line."""
    at = taken.groupBy("root").agg(F.min(F.struct("file", "line")).alias("at"))
    j = roots.where("kind in ('function', 'method')").select("root").join(at, "root")
    return _flag(j, "dynamic_runtime_dependency", "address taken", F.concat_ws(":", "at.file", "at.line"))


def loading_flags(roots: DataFrame) -> DataFrame:
    """Functions that load or dispatch code by name. roots: root, kind, tokens (of both versions)."""
    hit = F.array_sort(F.array_intersect(F.col("tokens"), F.lit(DYNAMIC)))
    return _flag(roots.where("kind in ('function', 'method')").where(F.size(hit) > 0), "dynamic_runtime_dependency", "loads code", F.array_join(hit, ", "))


def macro_flags(roots: DataFrame, defines: DataFrame) -> DataFrame:
    """Changes under conditions of which not every branch is built, and those that read a debug macro where there is only
    one configuration.

    roots: root, kind, conditions (array), tokens; defines: entry, names (array), build: one row a compile command."""
    entries, builds = defines.agg(F.count(F.lit(1)), F.countDistinct("build")).first()
    per = defines.select("entry", F.explode("names").alias("name")).groupBy("name").agg(F.countDistinct("entry").alias("k"))
    names = F.array_except(F.array_distinct(F.flatten(F.transform("conditions", lambda c: F.regexp_extract_all(c, F.lit(f"({IDENT})"), F.lit(1))))), F.lit(["defined", "if", "elif", "else", "true", "false", "and", "or", "not"]))
    some = roots.where(F.size("conditions") > 0)
    each = some.select("root", "kind", F.explode_outer(names).alias("name")).join(per, "name", "left")
    always = F.coalesce("k", F.lit(0))
    one = each.groupBy("root", "kind").agg(F.array_sort(F.collect_set(F.when((always == 0) | (always == entries), F.col("name")))).alias("single"))
    guarded = one.where(F.lit(entries == 0) | (F.col("kind") == "file") | (F.size("single") > 0))
    debug = F.array_sort(F.array_intersect(F.col("tokens"), F.lit(DEBUG_MACROS)))
    plain = roots.where((F.coalesce(F.size("conditions"), F.lit(0)) <= 0) & (F.col("kind") != "file") & (F.size(debug) > 0) & F.lit(builds < 2))
    cat = "build_config_incomplete_macro"
    return _flag(guarded, cat, "one branch is built", F.array_join("single", ", ")).unionByName(_flag(plain, cat, "one build", F.array_join(debug, ", ")))


def unresolved_flags(roots: DataFrame, missed: DataFrame) -> DataFrame:
    """Roots that a provider failed to resolve. roots, missed: root."""
    return _flag(roots.select("root").distinct().join(missed.select("root").distinct(), "root", "left_semi"), "provider_unresolved", "provider")


SHOWN = 5


def break_flags(breaks: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Roots whose data leave the traced paths: the first places and how many more. breaks: root, place."""
    few = first_k(breaks.distinct(), ["root"], [F.col("place")], shown)
    return first_breaks(few.join(breaks.distinct().groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root"), shown)


def first_breaks(few: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The same of the first places only. few: root, place, n (how many places the root has)."""
    g = few.groupBy("root").agg(F.array_sort(F.collect_list("place")).alias("ps"), F.max("n").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" and "), F.col("n") - shown, F.lit(" more"))).otherwise("")
    return _flag(g, "dynamic_runtime_dependency", "data leaves", F.concat(F.array_join("ps", "; "), more))


def foreign_flags(calls: DataFrame, shown: int = 10) -> DataFrame:
    """Roots that call code outside: the first callees and how many more. calls: root, callee."""
    one = calls.select("root", "callee").distinct()
    few = first_k(one, ["root"], [F.col("callee")], shown).groupBy("root").agg(F.array_sort(F.collect_list("callee")).alias("cs"))
    g = few.join(one.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" and "), F.col("n") - shown, F.lit(" more"))).otherwise("")
    return _flag(g, "dynamic_runtime_dependency", "foreign code", F.concat(F.array_join("cs", ", "), more))


def registered_flags(sources: DataFrame, taken: DataFrame, virtual: DataFrame) -> DataFrame:
    """Guarded functions some of whose callers are callbacks or virtual, so that more may call them. sources: root
    (the guarded function), source; taken, virtual: source."""
    odd = taken.select("source", F.lit("callback").alias("how")).unionByName(virtual.select("source", F.lit("virtual").alias("how"))).distinct()
    j = sources.select("root", "source").distinct().join(odd, "source")
    return _flag(j.groupBy("root").agg(F.array_sort(F.collect_set("how")).alias("h"), F.countDistinct("source").alias("n")), "dynamic_runtime_dependency", "reached at run time", F.concat_ws(" ", F.array_join("h", ","), "n"))


def without_flagged(risks: DataFrame, flags: DataFrame) -> DataFrame:
    """Risk rows of the roots that get cases: those with a flag INSTEAD_OF_CASES do not, nor does what only they reach."""
    return risks.join(flags.where(F.col("category").isin(*INSTEAD_OF_CASES)).select("root").distinct(), "root", "left_anti")


# --- where a case must be checked

# Groups of risks that only a run shows, with the reasons they stand under.
RUN_GROUPS = {"thread_safety": None, "ownership_lifetime": None, "abi_layout": "member_change", "build_config": None}
REVIEW_SUBS = ["logging", "test_code"]
# Patterns of code that depends on the machine it runs on.
TARGET_PATTERNS = {
    "hardware access": r"\bvolatile\b|\b(?:__asm__|__asm|asm)\b|\(\s*\w+\s*\*\s*\)\s*0x[0-9a-fA-F]{4,}|reinterpret_cast\s*<[^>]*\*\s*>\s*\(\s*0x|\b(?:HAL|LL)_[A-Z]\w*|\b(?:GPIO|UART|USART|SPI|I2C|DMA|ADC|DAC|PWM|NVIC|SysTick|RCC|EEPROM)\w*|\b(?:ioctl|mmap|munmap)\s*\(|\"/dev/|\b\w*(?:reg_read|reg_write|read_reg|write_reg)\w*",
    "interrupt": r"\b\w*(?:IRQHandler|_isr|_ISR)\b|\bISR\s*\(|\b(?:__disable_irq|__enable_irq|local_irq_\w+|disable_irq|enable_irq|irq_\w+|portENTER_CRITICAL\w*|portEXIT_CRITICAL\w*|taskENTER_CRITICAL\w*|taskEXIT_CRITICAL\w*)\b|__attribute__\s*\(\(\s*(?:interrupt|isr)",
    "timing": r"\b(?:sleep|usleep|nanosleep|sleep_for|sleep_until|delay|delay_ms|delay_us|udelay|mdelay|msleep|HAL_Delay|vTaskDelay|vTaskDelayUntil|osDelay|k_sleep|k_msleep|steady_clock|system_clock|high_resolution_clock|clock_gettime|gettimeofday|setitimer|xTimer\w+|osTimer\w+|timerfd_\w+)\b|\b\w*(?:[Tt]imeout|TIMEOUT|[Ww]atchdog|WATCHDOG|WDT|[Dd]eadline)\w*",
    "RTOS / threads": r"\b(?:xTask\w+|xQueue\w+|xSemaphore\w+|xEventGroup\w+|osThread\w+|osMutex\w+|osSemaphore\w+|osMessageQueue\w+|k_thread_\w+|k_sem_\w+|k_mutex_\w+|k_msgq_\w+|pthread_\w+|sem_(?:wait|post|timedwait)|__sync_\w+|__atomic_\w+|__DMB|__DSB|__ISB|atomic_thread_fence)\b|\bstd::(?:thread|async|atomic)\b",
    "bus / network I/O": r"\b(?:socket|recvfrom|sendto|sendmsg|recvmsg|setsockopt|epoll_\w+|tcsetattr|tcgetattr|cfsetispeed|cfsetospeed)\s*\(|\b(?:can|CAN|lin|LIN)_[A-Za-z]\w*",
    "memory layout / byte order": r"#\s*pragma\s+pack|__attribute__\s*\(\(\s*(?:packed|aligned|section)|\balignas\s*\(|\b(?:htons|htonl|ntohs|ntohl|htobe\d+|be\d+toh|htole\d+|le\d+toh|__builtin_bswap\d+|bswap_\d+)\b",
}
MAX_REASONS = 6


def target_hits(lines: DataFrame, by: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """(by, category, hit, no): for each group of lines and category the first line that hits it, comments aside.

    lines: by, no, text. patterns: more of them, by category; those of a known one are added to it."""
    known = dict(TARGET_PATTERNS)
    for k, v in (patterns or {}).items():
        known[k] = f"(?:{known[k]})|(?:{v})" if k in known else v
    code = F.regexp_replace(strip_comments(F.col("text")), r"//.*$", "")
    any_hit = reduce(lambda a, b: a | b, [code.rlike(p) for p in known.values()])
    found = F.filter(F.array(*[F.when(code.rlike(p), F.struct(F.lit(k).alias("category"), F.substring(F.btrim(F.regexp_extract(code, p, 0)), 1, 40).alias("hit"))) for k, p in known.items()]), lambda x: x.isNotNull())
    e = lines.where(any_hit).select(*by, "no", F.explode(found).alias("f"))
    return e.groupBy(*by, F.col("f.category").alias("category")).agg(F.min_by("f.hit", "no").alias("hit"), F.min("no").alias("no"))


def verify_by(cases: DataFrame, flags: DataFrame, root_hits: DataFrame, body_hits: DataFrame, most: int = MAX_REASONS) -> DataFrame:
    """(case, verify_by, reasons): target if there is any reason, else review; the first `most` reasons, in the order
    group, flag of the node itself (the first one), changed lines of its roots, its own body.

    cases: case, node, risk_group, sub_reason, roots (array); flags: root, category, ord; root_hits and body_hits: node,
    category, hit."""
    group = reduce(lambda a, kv: a | ((F.col("risk_group") == kv[0]) & (F.lit(True) if kv[1] is None else (F.col("sub_reason") == kv[1]))), RUN_GROUPS.items(), F.lit(False))
    first = flags.where(F.col("category").isin(*RUNTIME_FLAGS)).withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("ord"))).where("_k = 1").select(F.col("root").alias("node"), F.col("category").alias("reason"))
    c = cases.where(~F.col("sub_reason").isin(*REVIEW_SUBS))
    by_group = c.where(group).select("case", F.lit(0).alias("p"), F.concat(F.lit("group: "), "risk_group").alias("reason"))
    by_flag = c.join(first, "node").select("case", F.lit(1).alias("p"), F.concat(F.lit("flag: "), "reason").alias("reason"))
    hit = lambda h: F.concat_ws(": ", "category", "hit").alias("reason")
    roots = c.select("case", F.explode(F.array_distinct(F.concat(F.array("node"), "roots"))).alias("node"))
    by_root = roots.join(root_hits, "node").select("case", F.lit(2).alias("p"), F.concat(F.lit("changed: "), F.concat_ws(": ", "category", "hit")).alias("reason"))
    by_body = c.select("case", "node").join(body_hits, "node").select("case", F.lit(3).alias("p"), hit("").alias("reason"))
    rows = by_group.unionByName(by_flag).unionByName(by_root).unionByName(by_body).groupBy("case", "reason").agg(F.min("p").alias("p"))
    few = first_k(rows, ["case"], [F.col("p"), F.col("reason")], most)
    g = few.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "reason"))), lambda x: x["reason"]).alias("reasons"))
    j = cases.select("case").join(g, "case", "left")
    return j.select("case", F.when(F.col("reasons").isNull(), "review").otherwise("target").alias("verify_by"), F.coalesce("reasons", F.expr("cast(array() as array<string>)")).alias("reasons"))
