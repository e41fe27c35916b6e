"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of messages that no person typed, and of skill output.
SYSTEM_TAGS = ("<system-reminder", "<command-name", "<command-message", "<command-args", "<local-command", "<task-notification", "<user-prompt-submit-hook", "<environment_context", "<user_instructions", "<permissions")
SKILL_OUTPUT = "Base directory for this skill:"


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def clip(c: Column, n: int = 200) -> Column:
    """The first n characters, and three dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def one_line(c: Column, n: int) -> Column:
    """Stripped, line feeds as spaces, clipped."""
    return clip(F.replace(strip(c), F.lit("\n"), F.lit(" ")), n)


def head_and_tail(c: Column, most: int, marker: str = "\n...\n", head: float = 0.7) -> Column:
    """Beginning and end of a text that is longer than most, with a marker between."""
    a = int(most * head)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(a)), F.lit(marker), F.right(c, F.lit(most - a)))).otherwise(c)


def kebab(c: Column) -> Column:
    """Lower case, letters, digits and single dashes; the original where nothing is left."""
    k = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[\\s_]+", "-"), "[^a-z0-9-]", "")
    k = F.regexp_replace(F.regexp_replace(k, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(k == "", c).otherwise(k)


def short_path(c: Column, keep: int, home: str | None = None) -> Column:
    """The last `keep` parts of a path, the home folder as ~."""
    p = F.regexp_replace(c, "^" + home, "~") if home else c
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.when(F.size(parts) > keep, F.concat(F.lit(".../"), F.array_join(F.slice(parts, -keep, keep), "/"))).otherwise(p)


def meaningful_prompt(c: Column) -> Column:
    """Whether a user's message says something: not blank, no system tag, no skill output, no short slash command, no bare [...]."""
    t = strip(F.coalesce(c, F.lit("")))
    single = ~F.contains(t, F.lit("\n"))
    tag = F.lit(False)
    for x in SYSTEM_TAGS:
        tag = tag | t.startswith(x)
    command = t.startswith("/") & single & (F.size(F.split(t, "\\s+")) <= 3)
    return (t != "") & ~tag & ~t.startswith(SKILL_OUTPUT) & ~command & ~(t.startswith("[") & t.endswith("]") & single)


def parts_to_text(parts: Column, separator: str = " ", placeholder: bool = True) -> Column:
    """Text of content parts (structs with type and text): others as [type] or left out."""
    other = lambda p: F.concat(F.lit("["), p.getField("type"), F.lit("]"))
    said = F.transform(parts, lambda p: F.when(p.getField("type") == "text", p.getField("text")).otherwise(other(p) if placeholder else F.lit(None)))
    return F.array_join(F.filter(said, lambda x: x.isNotNull() & (x != "")), separator)


def as_text(v: Column) -> Column:
    """A JSON value (variant) as text: a string as it is, a list as the texts of its items by line, all else as JSON; null is empty."""
    kind = F.schema_of_variant(v)
    text_of = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.to_json(x)))
    listed = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), text_of), "\n")
    return F.coalesce(F.when(kind == "STRING", v.cast("string")).when(kind.startswith("ARRAY"), listed).when(kind != "VOID", F.to_json(v)), F.lit(""))


def wall_time(c: Column) -> Column:
    """The seconds that a tool's output says it took, in the lines before the output itself; null without them."""
    return F.nullif(F.regexp_extract(c, "(?m)\\A(?:.*\\n){0,4}?Wall time: ([0-9]+(?:\\.[0-9]+)?) seconds?", 1), F.lit("")).cast("double")


def tool_output(c: Column) -> Column:
    """A tool's output without the lines of exit code and wall time before it."""
    return F.regexp_replace(c, "\\A(?:(?:Exit code|Process exited with code|Wall time|Total output lines|Chunk ID|Original token count)[: ].*\\n)+(?:Output:\\n)?", "")


def exit_code(c: Column) -> Column:
    """The exit code that a tool's output opens with; null without one."""
    return F.nullif(F.regexp_extract(c, "^(?:Exit code|Process exited with code)[: ]+(-?[0-9]+)", 1), F.lit("")).cast("int")


def front_matter(c: Column) -> Column:
    """The block between --- lines that a text opens with; null without one."""
    return F.nullif(F.regexp_extract(c, "(?s)\\A---\\r?\\n(.*?)\\r?\\n---(?:\\r?\\n|\\z)", 1), F.lit(""))


def front_matter_values(c: Column) -> Column:
    """The front matter as a map from key to text, by its simple lines: scalars without their quotes, [a, b] and indented lists as a, b; what is nested deeper is left out."""
    lines = F.split(F.coalesce(front_matter(c), F.lit("")), "\\r?\\n")
    bare = lambda x: F.regexp_replace(strip(F.regexp_replace(x, "\\s+#.*$", "")), "^([\"'])(.*)\\1$", "$2")
    flat = lambda x: F.when(F.regexp_like(x, F.lit("^\\[.*\\]$")), F.array_join(F.transform(F.split(F.regexp_replace(x, "^\\[|\\]$", ""), ","), bare), ", ")).otherwise(bare(x))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "(?m)\\n[ \\t]*-[ \\t]+", "\u0001")
    pairs = F.filter(F.split(joined, "\n"), lambda x: F.regexp_like(x, F.lit("^[A-Za-z0-9_-]+[ \\t]*:(?:[ \\t\u0001]|$)")))
    value = lambda x: F.regexp_replace(x, "^[^:]*:[ \\t]*", "")
    entry = lambda x: F.struct(strip(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), F.when(F.contains(x, F.lit("\u0001")), F.array_join(F.transform(F.filter(F.split(value(x), "\u0001"), lambda y: strip(y) != ""), bare), ", ")).otherwise(flat(value(x))).alias("value"))
    # The last of several lines with one key counts.
    return F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e.getField("key")), F.create_map(e.getField("key"), e.getField("value"))))


#: State of front_matter_paths(): open keys with their indents (the number of an item where it is one), what was found, and the block scalar that is open.
_OPEN = "array<struct<indent:int,key:string,item:int>>"
_MATTER = f"struct<open:{_OPEN},found:array<struct<path:string,value:string>>,block:int,base:int,fold:boolean>"


def front_matter_paths(c: Column) -> Column:
    """The front matter as a map from path to text, whatever its depth: `a.b` for keys in keys, `a.0` for items of lists, `a.0.b` for keys of such items.

    A stack of open keys and their indents goes over the lines. Read are nested maps, lists
    (at their key's indent too), lists of maps, [a, b], quoted and plain scalars with their
    further lines, and block scalars: | keeps line breaks, > makes them spaces, both without
    the last one. Comments go. The last of several values of one path counts. Keys without a value
    and maps in braces, which stay as they are written, are the limits. Empty without front matter.
    """
    key_of = "\"[^\"]*\"|'[^']*'|(?:[^\\s\"'\\[{#&*!|>-]|-\\S)[^:]*?"
    bare = lambda x: F.regexp_replace(strip(F.regexp_replace(x, "^((?:[^\"'#]|(?<=\\S)#)*|\"[^\"]*\"|'[^']*')\\s+#.*$", "$1")), "^([\"'])(.*)\\1$", "$2")
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  (names a value, so that it is worked out once)

    def told(x: Column) -> Column:
        """A line by itself: indent of the line and of what stands behind its dash, its key, what kind of value it has and the value."""
        text = F.regexp_extract(x, "^ *(?:-(?=\\s|$)\\s*)?(.*?)\\s*$", 1)
        keyed = F.regexp_like(text, F.lit(f"^(?:{key_of})\\s*:(?:\\s|$)"))
        line = F.struct(x.alias("raw"), F.length(F.regexp_extract(x, "^( *)", 1)).alias("indent"), F.length(F.regexp_extract(x, "^( *(?:-(?=\\s|$)\\s*)?)", 1)).alias("inner"), F.regexp_like(x, F.lit("^ *-(?:\\s|$)")).alias("dash"), F.when(keyed, bare(F.regexp_extract(text, f"^({key_of})\\s*:", 1))).alias("key"), F.when(keyed, F.regexp_replace(text, f"^(?:{key_of})\\s*:\\s*", "")).otherwise(text).alias("value"))
        kind = lambda v: F.when((v == "") | v.startswith("#"), "none").when(F.regexp_like(v, F.lit("^[|>][-+0-9]*\\s*(?:#.*)?$")), F.left(v, F.lit(1))).when(F.regexp_like(v, F.lit("^\\[.*\\]$")), "list").otherwise("text")
        parts = lambda v: F.filter(F.transform(F.split(F.regexp_replace(v, "^\\[|\\]$", ""), ","), bare), lambda y: y != "")
        return let(line, lambda n: F.struct(*[n.getField(k).alias(k) for k in ("raw", "indent", "inner", "dash", "key")], kind(n.getField("value")).alias("kind"), bare(n.getField("value")).alias("bare"), parts(n.getField("value")).alias("parts")))

    def step(s: Column, n: Column) -> Column:
        open_, found, block, base, fold = (s.getField(k) for k in ("open", "found", "block", "base", "fold"))
        raw, indent, kind, key = (n.getField(k) for k in ("raw", "indent", "kind", "key"))
        blank = strip(raw) == ""
        is_item = lambda k: k.getField("item") >= 0
        # Inside a block scalar, or the further line of a plain one: the last value grows.
        at = F.when((base < 0) & ~blank, indent).otherwise(base)
        in_block = (block >= 0) & (blank | (indent > block))
        line = F.when(block < 0, n.getField("bare")).when(blank, F.lit("")).otherwise(F.substring(raw, at + 1, F.length(raw)))
        last = F.element_at(found, -1)
        glue = F.when((block < 0) | (fold & ~blank & ~last.getField("value").endswith("\n")), F.lit(" ")).when(fold & ~blank, F.lit("")).otherwise(F.lit("\n"))
        grown = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(last.getField("path").alias("path"), F.coalesce(F.concat(last.getField("value"), glue, line), line).alias("value"))))
        further = ~n.getField("dash") & key.isNull()
        # Else a key or an item: deeper ones close. Keys at an item's own indent stay open, and the item before it gives its number.
        number = F.coalesce(F.try_element_at(F.filter(open_, lambda k: (k.getField("indent") == indent) & is_item(k)), F.lit(1)).getField("item") + 1, F.lit(0))
        entry = lambda i, k, item: F.array(F.struct(i.cast("int").alias("indent"), k.alias("key"), item.cast("int").alias("item")))
        kept = F.filter(open_, lambda k: (k.getField("indent") < indent) | (n.getField("dash") & (k.getField("indent") == indent) & ~is_item(k)))
        none = F.array().cast(_OPEN)
        now = F.concat(kept, F.when(n.getField("dash"), entry(indent, number.cast("string"), number)).otherwise(none), F.when(key.isNotNull(), entry(n.getField("inner"), key, F.lit(-1))).otherwise(none))

        def opened(o: Column) -> Column:
            path = F.array_join(F.transform(o, lambda k: k.getField("key")), ".")
            values = F.when(kind == "list", n.getField("parts")).when(kind == "none", F.array().cast("array<string>")).otherwise(F.array(F.when(kind == "text", n.getField("bare"))))
            new = F.transform(values, lambda v, i: F.struct(F.when(kind == "list", F.concat_ws(".", path, i.cast("string"))).otherwise(path).alias("path"), v.alias("value")))
            is_block = kind.isin("|", ">")
            return F.struct(o.alias("open"), F.concat(found, new).alias("found"), F.when(is_block, F.when(key.isNull(), indent).otherwise(n.getField("inner"))).otherwise(-1).cast("int").alias("block"), F.lit(-1).alias("base"), (kind == ">").alias("fold"))

        same = lambda found_, block_: F.struct(open_.alias("open"), found_.alias("found"), block_.cast("int").alias("block"), at.cast("int").alias("base"), fold.alias("fold"))
        return (
            F.when(in_block, same(grown, block).cast(_MATTER))
            .when(blank | ltrimmed(raw).startswith("#"), F.struct(open_.alias("open"), found.alias("found"), F.lit(-1).alias("block"), F.lit(-1).alias("base"), F.lit(False).alias("fold")).cast(_MATTER))
            .when(further, F.struct(open_.alias("open"), F.when((indent > 0) & (F.size(found) > 0) & (block < 0), grown).otherwise(found).alias("found"), F.lit(-1).alias("block"), F.lit(-1).alias("base"), F.lit(False).alias("fold")).cast(_MATTER))
            .otherwise(let(now, opened).cast(_MATTER))
        )

    ltrimmed = lambda x: F.regexp_replace(x, "^\\s+", "")
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast("array<struct<path:string,value:string>>").alias("found"), F.lit(-1).alias("block"), F.lit(-1).alias("base"), F.lit(False).alias("fold")).cast(_MATTER)
    lines = F.transform(F.split(F.coalesce(front_matter(c), F.lit("")), "\\r?\\n"), told)
    found = F.aggregate(lines, start, step, lambda s: s.getField("found"))
    trimmed = F.transform(found, lambda e: F.struct(e.getField("path").alias("key"), F.regexp_replace(F.coalesce(e.getField("value"), F.lit("")), "\n+$", "").alias("value")))
    last_of = lambda t: F.map_from_entries(F.transform(F.array_distinct(F.transform(t, lambda e: e.getField("key"))), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(t, lambda e: e.getField("key") == k), -1).getField("value").alias("value"))))
    return let(trimmed, last_of)


def user_kind(c: Column) -> Column:
    """Who wrote a message in the user's name: `system` for tags, interruptions and continuations, `auto` for prompts that carry out a plan, else `user`."""
    t = strip(F.coalesce(c, F.lit("")))
    tag = F.lit(False)
    for x in SYSTEM_TAGS:
        tag = tag | t.startswith(x)
    system = tag | t.startswith("[Request interrupted") | t.startswith("This session is being continued")
    return F.when(system, "system").when(t.startswith("Implement the following plan"), "auto").otherwise("user")


def body(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)\\A---\\r?\\n.*?\\r?\\n---(?:\\r?\\n|\\z)", "")


def fenced(c: Column) -> Column:
    """What stands in the widest code fence of a model's answer, or all of it."""
    inner = F.regexp_extract(c, "(?s)```(?:[a-zA-Z]+)?\\s*\\n?(.*)```", 1)
    return strip(F.when(inner != "", inner).otherwise(c))


def without_part(c: Column) -> Column:
    """A session id without the suffix of a split part."""
    return F.regexp_replace(c, "_part[0-9]+$", "")


def data_url(c: Column) -> Column:
    """Media type and content of a base64 data URL; null for others."""
    pattern = "(?s)^data:([^;,]+);base64,(.*)$"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.struct(F.regexp_extract(c, pattern, 1).alias("media_type"), F.regexp_extract(c, pattern, 2).alias("data")))


def stable_id(namespace: str, *parts: Column) -> Column:
    """An id that the same parts always give."""
    return F.concat(F.lit(namespace + "-"), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(24)))


def set_key(ids: Column) -> Column:
    """A key of a set of ids, whatever their order."""
    return F.left(F.sha2(F.array_join(F.array_sort(ids), ","), 256), F.lit(16))


def argument_summary(tool: Column, arguments: Column, n: int = 80) -> Column:
    """The arguments of a call that tell most: by tool, or else the first that is known."""
    # Which arguments are shown for which tool.
    shown = {"Write": ("file_path",), "Edit": ("file_path",), "Read": ("file_path",), "Bash": ("command",), "Glob": ("pattern", "path"), "Grep": ("pattern", "path"), "WebFetch": ("url",), "WebSearch": ("query",)}
    v = F.try_parse_json(arguments)
    get = lambda k: one_line(F.try_variant_get(v, f"$.{k}", "string"), n)
    line = lambda keys: F.concat_ws(" ", *[F.when(get(k).isNotNull(), F.concat(F.lit(k + "="), get(k))) for k in keys])
    every = list(dict.fromkeys(k for keys in shown.values() for k in keys))
    out = None
    for t, keys in shown.items():
        out = (F.when if out is None else out.when)(tool == t, line(keys))
    return out.otherwise(F.coalesce(*[F.when(get(k).isNotNull(), F.concat(F.lit(k + "="), get(k))) for k in every], F.lit("")))
