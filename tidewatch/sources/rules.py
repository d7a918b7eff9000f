"""Rules from YAML files and from tables."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.plans.rules import Action, Rule, collect_rules, registered


class RuleFileError(ValueError):
    """A rule file cannot be read."""


def _moment(value: object) -> datetime:
    if value is None:
        return datetime.now(UTC)
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def _rule(data: dict) -> Rule:
    actions = []
    for entry in data.get("actions", []):
        if entry["type"] not in schema.ACTION_TYPES:
            raise ValueError(f"unknown action type: {entry['type']}")
        actions.append(Action(**{k: entry[k] for k in Action.__dataclass_fields__ if k in entry}))
    given = {
        k: data[k] for k in ("description", "priority", "enabled", "created_by", "version") if k in data
    }
    return Rule(
        id=data["id"], name=data["name"], condition=data["condition"], actions=tuple(actions),
        tags=tuple(data.get("tags", [])), created_at=_moment(data.get("created_at")),
        updated_at=_moment(data.get("updated_at")), **given,
    )


def yaml_rules(path: str | Path) -> list[Rule]:
    """Rules of a file, or of all YAML files below a folder; several documents per file.

    Rule files are small configuration and are read where the job is started.
    """
    try:
        import yaml
    except ImportError as error:
        raise RuleFileError("reading rule files needs PyYAML") from error
    root = Path(path)
    if not root.exists():
        raise RuleFileError(f"no such file or folder: {root}")
    files = [root] if root.is_file() else sorted([*root.glob("**/*.yaml"), *root.glob("**/*.yml")])
    found: list[Rule] = []
    for file in files:
        try:
            documents = list(yaml.safe_load_all(file.read_text(encoding="utf-8")))
            found += [_rule(d) for d in documents if d is not None]
        except Exception as error:
            raise RuleFileError(f"cannot load {file}: {error}") from error
    return registered(found)


def table_rules(table: DataFrame) -> list[Rule]:
    """Enabled rules of a table with the columns of ``schema.RULES``, highest priority first."""
    rules = collect_rules(table.filter(F.col("enabled")))
    return sorted(rules, key=lambda r: -r.priority)


def read_rule_table(spark: SparkSession, name_or_path: str, format: str = "parquet", **options) -> list[Rule]:
    """Rules stored in files or behind a connector such as ``jdbc``."""
    reader = spark.read.format(format).options(**options)
    table = reader.load(name_or_path) if format != "jdbc" else reader.option("dbtable", name_or_path).load()
    return table_rules(table)
