"""Tags, roles and levels of detail from source text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
BLACKLIST = (
    "task_id path symbol error ok status result data value key name type content text item items entry record row field col msg message "
    "args kwargs self cls config options params headers payload request response i j k x y z n m idx index flag enabled disabled active "
    "inactive obj val tmp temp buf buffer str num count total sum"
).split()
QUERY_BLACKLIST = (
    "task_id path symbol error ok status result data value key name type content text item items entry record row field col msg message "
    "args kwargs self cls config options params headers payload request response output input buffer offset length index count total size "
    "kind node parent child children source target source_code __init__ __repr__ __str__ __eq__ __hash__ __len__"
).split()
GENERIC = (
    "main __init__ run start stop scan setup append insert get set add remove delete create update fetch read close open write validate "
    "execute handle process dispatch __call__ __enter__ __exit__ __str__ __repr__ __len__ __getitem__ __setitem__ __delitem__ __contains__ "
    "__iter__ __next__ __eq__ __hash__ on_startup on_shutdown cleanup teardown"
).split()
GENERIC_PREFIXES, GENERIC_SUFFIXES = ("cat::", "_", "__"), ("_cb", "_fn", "_handler", "_callback", "_cb_")
BEHAVIOUR = {
    "async": r"\basync\b", "await": r"\bawait\b", "lock": r"\block\b", "mutex": r"\bmutex\b", "semaphore": r"\bsemaphore\b", "try": r"\btry\b", "catch": r"\bcatch\b",
    "except": r"\bexcept\b", "finally": r"\bfinally\b", "with": r"\bwith\b", "context_manager": r"__enter__|__exit__", "generator": r"\byield\b", "decorator": r"@\w+",
    "class": r"\bclass\b", "function": r"\bdef\b|\bfunction\b", "import": r"\bimport\b|\bfrom\b", "loop": r"\bfor\b|\bwhile\b", "conditional": r"\bif\b|\belse\b",
    "return": r"\breturn\b", "raise": r"\braise\b|\bthrow\b",
}
BY_LANGUAGE = {"python": {"asyncio": ["asyncio"], "threading": ["threading"], "multiprocessing": ["multiprocessing"]}, "typescript": {"promise": ["Promise"], "timer": ["setTimeout", "setInterval"]}}
CATEGORIES = {
    "async": r"\bawait\b",
    "lock": r"\b(asyncio\.)?Lock\b|\bRLock\b|\bSemaphore\b|\bthreading\.Lock\b",
    "raii": r"__enter__|__exit__|with\s+self\b",
    "error": r"\bexcept\b|\braise\b|\btry\s*:|\bException\b|\btraceback\b",
    "database": r"\basyncpg\b|\bpsycopg\b|\bsqlalchemy\b|\bSELECT\b|\bINSERT\b|\btransaction\b",
    "network": r"\brequests\.|\bhttpx\.|\baiohttp\.|\bsocket\.|\burllib|\btcp\b|\budp\b",
    "filesystem": r"\bPath\(|\.read_text|\.write_text|\bos\.path\b|\bshutil\b",
    "hash": r"\bhashlib\b|\bsha256\b|\bmd5\b|checksum|\bdigest\b",
    "parse": r"\bast\.parse\b|\bre\.compile\b|\btokenize\b|\bjson\.loads\b|\byaml\.safe_load\b",
    "security": r"\bauth\b|\bencrypt\b|\bdecrypt\b|\bhashlib\b|password|\btoken\b",
    "signal": r"\bSIGINT\b|\bSIGTERM\b|\bsignal\.|\batexit\b",
    "io_bound": r"\baiofiles\b|\.read_text|\.write_text|\.stream\(|\.buffer\b",
    "vram_control": r"vram|\bloadModel\b|\bunloadModel\b|\bGPU\b|\bollama\b",
    "atomic": r"\bLock\b|\bRLock\b|\bEvent\b|\bCondition\b|atomic",
    "generator": r"\byield\b",
    "memory": r"\bmalloc\b|\bfree\(|\bgc\.collect\b|\bweakref\b|\bmmap\b",
}
ENTRY_DECORATORS = ["click.command", "click.group", "app.route", "router.get", "router.post", "router.put", "router.delete"]
ENTRY_NAMES = "main cli run start serve".split()
COORDINATORS = "orchestrat manager coordinator dispatcher scheduler controller handler broker mediator".split()
TRANSFORMERS = "transform convert mapper encoder decoder serialize deserialize normalize sanitize".split()
CONFIG_FILES = "config.py settings.py constants.py defaults.py".split()
CORE = "engine registry daemon kernel core".split()
LEVELS = [
    (["bug", "fix", "debug", "crash", "traceback"], "FULL", 0.95), (["understand", "explain", "describe", "summarize", "how does"], "SUMMARY", 0.30),
    (["dependencies", "dependency", "import", "call graph", "trace dep"], "HIDDEN", 0.10), (["refactor", "rename", "move", "extract", "inline"], "SKELETON", 0.80),
    (["architecture", "audit", "overview", "structure"], "SKELETON", 0.60), (["design"], "SUMMARY", 0.30),
]
COMPLEX = "class dto object dict list".split()


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _named(rules: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))))


def behaviour(code: Column, language: str = "python") -> Column:
    rules = {k: code.rlike("(?i)" + p) for k, p in BEHAVIOUR.items()}
    return _named(rules | {k: _any(code, w) for k, w in BY_LANGUAGE.get(language, {}).items()})


def decorators(code: Column) -> Column:
    """The dotted names after an @ at the start of a line."""
    return F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*@([A-Za-z_][\w.]*)"), 1)


def categories(code: Column, name: Column, kind: Column | None = None, decorated: Column | None = None) -> Column:
    """Sorted tags by the code's patterns, an asynchronous kind, any decorator, and names or decorators of entry points."""
    rules = {k: code.rlike(p) for k, p in CATEGORIES.items()}
    entry = name.isin(ENTRY_NAMES)
    if kind is not None:
        rules["async"] = rules["async"] | (kind == "async_function")
    if decorated is not None:
        rules["decorator"] = F.exists(decorated, lambda d: F.trim(d) != "")
        entry = entry | F.arrays_overlap(decorated, F.array(*map(F.lit, ENTRY_DECORATORS)))
    return _named(rules | {"entry_point": entry})


def role(kind: Column, tags: Column, name: Column, path: Column, calls: Column) -> Column:
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    n, file = F.lower(name), F.substring_index(path, "/", -1)
    return (
        F.when((kind == "class") & has("raii", "lock", "atomic"), "resource_manager").when(has("filesystem", "network", "database", "io_bound"), "io_handler")
        .when((calls >= 5) | _any(n, COORDINATORS), "coordinator").when(has("parse") | _any(n, TRANSFORMERS), "transformer")
        .when(file.isin(CONFIG_FILES) | _any(n, ["config", "constant"]), "configuration").when((kind == "class") & (F.size(tags) == 0), "container")
        .when(_any(n, CORE), "core_infrastructure").otherwise("unknown")
    )


def level(task: Column) -> tuple[Column, Column]:
    """(level of detail, precision) that a task calls for: the first rule with a word of it."""
    t, name, alpha = F.lower(F.coalesce(task, F.lit(""))), F.lit("SKELETON"), F.lit(0.70)
    for words, level_, a in reversed(LEVELS):
        name, alpha = F.when(_any(t, words), F.lit(level_)).otherwise(name), F.when(_any(t, words), F.lit(a)).otherwise(alpha)
    return name, alpha


def skeleton(code: Column) -> Column:
    """The lines that declare or decorate."""
    return F.array_join(F.filter(F.split(code, "\n"), lambda line: line.rlike(r"^\s*(@|class\s|def\s|async\s+def\s|import\s|from\s)")), "\n")


def generic(symbol: Column) -> Column:
    name, out = F.replace(symbol, F.lit("sym::"), F.lit("")), F.lit(False)
    for p in GENERIC_PREFIXES:
        out = out | symbol.startswith(p)
    for s in GENERIC_SUFFIXES:
        out = out | name.endswith(s)
    return out | name.isin(GENERIC)


def data_complexity(data_type: Column) -> Column:
    return F.when(_any(F.lower(F.coalesce(data_type, F.lit(""))), COMPLEX), "complex").otherwise("simple")
