"""Tool names and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which tools belong to which category; any other tool is `other`.
CATEGORIES = {
    "file_read": ("Read", "read_file", "cat", "NotebookRead"),
    "search": ("Glob", "glob", "Grep", "grep", "find", "LS", "ls"),
    "file_write": ("Edit", "Write", "write_file", "NotebookEdit", "MultiEdit", "apply_patch", "apply-patch"),
    "shell": ("Bash", "bash", "shell", "execute_command"),
    "web": ("WebSearch", "WebFetch", "web_search"),
    "agent": ("Agent", "Task", "Skill"),
    "interact": ("AskUserQuestion", "AskUser", "EnterPlanMode", "ExitPlanMode", "EnterWorktree"),
    "task": ("TodoWrite", "TodoRead", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskOutput", "TaskStop"),
}


def category(tool: Column) -> Column:
    known = F.create_map(*[F.lit(x) for c, names in CATEGORIES.items() for n in names for x in (n, c)])
    return F.coalesce(F.try_element_at(known, tool), F.lit("other"))


def path_of(arguments: Column) -> Column:
    """File path among a call's JSON arguments: the first of five keys that holds a non-empty string."""
    keys = ("file_path", "path", "filename", "notebook_path", "directory")
    v = F.try_parse_json(arguments)
    found = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(F.schema_of_variant(x) == "STRING", F.nullif(x.cast("string"), F.lit(""))) for x in found])
