"""Sets of tool names. They differ on purpose and are not merged; `tool_class` has them as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tool names by use.
BASH = ("Bash", "bash", "execute_command", "run_command")
READS = ("Read", "View", "read_file", "ReadFile")
WRITES = ("Write", "Edit", "write_file", "edit_file", "WriteFile", "NotebookEdit", "MultiEdit")
SINGLE_WRITES = ("Write", "Edit", "write_file", "edit_file", "WriteFile", "NotebookEdit")
MODIFYING = (*SINGLE_WRITES, *BASH)
SEARCHES = ("Grep", "Glob", "grep", "glob", "search")
NATIVE = ("Read", "Grep", "Glob", "Write", "Edit", "MultiEdit", "NotebookEdit", "WebSearch", "WebFetch")

CLASSES = {"bash": BASH, "file_read": READS, "file_write": WRITES, "write": SINGLE_WRITES, "modifying": MODIFYING, "grep_like": SEARCHES, "native": NATIVE}


def tool_class(spark: SparkSession) -> DataFrame:
    """(class, tool): every set as rows, for joins."""
    return spark.createDataFrame([(c, t) for c, names in CLASSES.items() for t in names], "class string, tool string")


def action(tool: Column) -> Column:
    """read, write, edit, search or bash."""
    name = F.lower(tool)
    return F.when(name == "read", "read").when(name == "write", "write").when(name.isin("edit", "multiedit", "notebookedit"), "edit").when(name.isin("grep", "glob"), "search").otherwise("bash")
