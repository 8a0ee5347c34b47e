"""Models of library functions as edges: what a call of one means for the analysis.

calls: site, name (of the callee, versions cut), args (array of nodes). A model is a kind per name; each kind is a few
edges over the site's result and arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import without_version
from .fixpoint import union

# fixed values: names by what a call of them does
ALLOCATES = ("malloc", "calloc", "memalign", "aligned_alloc", "mmap", "__mmap", "_Znwm", "fopen", "fdopen", "__libc_malloc", "__libc_calloc", "__libc_memalign")
REALLOCATES = ("realloc", "reallocarray", "__libc_realloc")
ALLOCATES_INTO = ("posix_memalign",)
RETURNS_FIRST = ("memcpy", "memmove", "memset", "memchr", "memrchr", "strstr", "memmem", "__memmove_chk_avx512_unaligned_erms", "_ZStlsISt11char_traitsIcEERSt13basic_ostreamIcT_ES5_PKc", "_ZNSolsEi")
COPIES_CONTENTS = ("memcpy", "memmove", "__memmove_chk_avx512_unaligned_erms")
THREAD = "_ZNSt6thread15_M_start_threadESt10unique_ptrINS_6_StateESt14default_deleteIS1_EEPFvvE"
# which argument is called, and which ones it gets
CALLS_BACK = {"pthread_create": (2, (3,)), THREAD: (2, ()), "qsort": (3, (0,)), "qsort_r": (3, (0, 4))}
ATTACHES = ("shmat",)
COOKIE = ("fopencookie",)
CONSERVATIVE = r"^_ZSt.*_Rb_tree_"
EMPTY = (
    "free", "strlen", "__strlen_evex", "strcmp", "strncmp", "bind", "accept", "accept4", "listen", "perror", "localeconv", "pthread_mutex_init", "pthread_mutex_lock",
    "pthread_mutex_unlock", "pthread_mutex_destroy", "pthread_mutex_trylock", "abort", "atan2", "atan2f", "atan2l", "exp", "expf", "expl", "modf", "modff", "modfl", "eventfd",
    "bcmp", "memcmp", "clock_gettime", "close", "exit", "munmap", "rand", "rand_r", "srand", "clearerror", "feof", "ferror", "fileno", "_ZdlPvm", "iconv_open", "iconv",
    "iconv_close", "isspace", "tolower", "toupper", "strtod", "strtol", "strtoll", "__isoc23_strtol", "strtoull", "__isoc23_strtoul", "printf", "puts",
)


def resolve(names: DataFrame) -> DataFrame:
    """node, name, model of symbols (node, name; no locals) that a model replaces."""
    plain = without_version(F.col("name"))
    kind = F.when(plain.isin(*ALLOCATES, *REALLOCATES, *ALLOCATES_INTO), "allocator").when(plain.isin(*EMPTY), "empty").when(plain.rlike(CONSERVATIVE), "conservative").when(plain.isin(*RETURNS_FIRST, *ATTACHES, *COOKIE), "forward").when(plain.isin(*CALLS_BACK), "callback")
    return names.select("node", plain.alias("name"), kind.alias("model")).where("model IS NOT NULL")


def edges(calls: DataFrame) -> DataFrame:
    """rel, dst, src: Alloc (dst gets the fresh object src), Assign, Load, Store, and IndirectCall (site dst calls what src points to)."""
    c = calls.select("site", without_version(F.col("name")).alias("name"), F.transform("args", lambda a: a.cast("string")).alias("args")).withColumn("site", F.col("site").cast("string"))
    arg = lambda i: F.get("args", F.lit(i))
    own = lambda what: F.concat(F.lit(f"{what}:"), F.col("site"))
    edge = lambda rows, rel, dst, src: rows.select(F.lit(rel).alias("rel"), dst.alias("dst"), src.alias("src")).where("dst IS NOT NULL AND src IS NOT NULL")
    of = lambda *names: c.where(F.col("name").isin(*names))
    site = F.col("site")
    out = [
        edge(of(*ALLOCATES, *REALLOCATES, *COOKIE, *ATTACHES), "Alloc", site, own("heap")),
        edge(of(*REALLOCATES), "Assign", site, arg(0)),
        edge(of(*ALLOCATES_INTO), "Alloc", own("tmp"), own("heap")),
        edge(of(*ALLOCATES_INTO), "Store", arg(0), own("tmp")),
        edge(of(*RETURNS_FIRST), "Assign", site, arg(0)),
        edge(of(*COPIES_CONTENTS), "Load", own("tmp"), arg(1)),
        edge(of(*COPIES_CONTENTS), "Store", arg(0), own("tmp")),
        edge(of(*ATTACHES), "Assign", site, arg(1)),
        edge(of(*COOKIE), "Store", site, arg(0)),
        # the table of functions comes by value, which is by a pointer once compiled
        edge(of(*COOKIE), "Load", own("tmp"), arg(2)),
        edge(of(*COOKIE), "Store", site, own("tmp")),
    ]
    for name, (fn, passed) in CALLS_BACK.items():
        out += [edge(of(name), "IndirectCall", site, arg(fn)), *(edge(of(name), "Pass", site, arg(i)) for i in passed)]
    wide = c.where(F.col("name").rlike(CONSERVATIVE))
    each = wide.select("site", F.explode("args").alias("a"))
    mix = F.concat(F.lit("mix:"), site)
    out += [edge(each, "Assign", mix, F.col("a")), edge(each, "Store", F.col("a"), mix), edge(wide, "Alloc", mix, own("heap")), edge(wide, "Assign", site, mix)]
    return union(out).distinct()


def substitute(edges_: DataFrame, moved: DataFrame) -> DataFrame:
    """edges (dst, src, ...) whose ends named in moved (old, new) are renamed: a body replaced by its model's."""
    for end in ("dst", "src"):
        m = moved.select(F.col("old").alias(end), F.col("new").alias("_new"))
        edges_ = edges_.join(m, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges_
