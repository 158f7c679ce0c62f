"""Job settings, scope lists and URL rules from sectioned list files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def read_sections(text: str) -> dict[str, list[str]]:
    """``[Name]`` starts a section; blank lines, lines that begin with ``<>`` and lines before the first section are left out."""
    sections: dict[str, list[str]] = {}
    current = None
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("<>"):
            continue
        if line.startswith("[") and line.endswith("]"):
            current = sections.setdefault(line[1:-1], [])
        elif current is not None:
            current.append(line)
    return sections


def pairs(lines: list[str]) -> list[tuple[str, str]]:
    """``name: value`` lines, split at the first colon that a blank follows (else the first colon)."""
    found = []
    for line in lines:
        name, _, value = line.partition(": ") if ": " in line else line.partition(":")
        found.append((name.strip(), value.strip()))
    return found


def _truth(value: str) -> bool:
    return value == "True"


@dataclass(frozen=True)
class JobSettings:
    """Settings of a crawl job; the request rate is given per minute and kept per second."""

    name: str | None = None
    version: int = 2
    max_attempts: int = 2
    monthly_budget: float = 100.0
    max_fetch_rate: float = 2.0
    maintenance_minutes: int = 10
    store_content: bool = True
    strict_robots: bool = False
    robots_compliant: bool = False
    google_compliant: bool = False
    filter_frontier: bool = False
    reference_job: str | None = None
    reference_version: int = 2
    seed_from_reference: bool = False
    user_agents: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> JobSettings:
        sections = read_sections(text)
        given = dict(pairs(sections.get("Global", [])))
        version = int(given.get("Version", 2))
        return cls(
            name=given.get("Name"),
            version=version,
            max_attempts=int(given.get("MaxProcessUrlAttempts", 2)),
            monthly_budget=float(given.get("MonthlyBudget", 100.0)),
            max_fetch_rate=int(given.get("MaxFetchRate", 120)) / 60.0,
            maintenance_minutes=int(given.get("LBMaintenanceCyclePeriod", 10)),
            store_content=_truth(given.get("StoreContent", "True")),
            strict_robots=_truth(given.get("StrictRobotsTxtParsing", "False")),
            robots_compliant=_truth(given.get("RobotExclusionStandardCompliant", "False")),
            google_compliant=_truth(given.get("GoogleExclusionStandardCompliant", "False")),
            filter_frontier=_truth(given.get("FilterFrontier", "False")),
            reference_job=given.get("ReferenceJob"),
            reference_version=int(given.get("ReferenceJobVersion", version)),
            seed_from_reference=_truth(given.get("SeedFromReferenceJob", "False")),
            user_agents=dict(pairs(sections.get("UserAgents", []))),
        )


@dataclass(frozen=True)
class Scope:
    """Patterns of a job: domains match anywhere in the domain, addresses from the start of the id."""

    include_domains: tuple[str, ...] = ()
    include_urls: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    exclude_urls: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Scope:
        sections = read_sections(text)
        return cls(*(tuple(sections.get(name, ())) for name in ("IncludeDomains", "IncludeUrls", "ExcludeDomains", "ExcludeUrls")))


@dataclass(frozen=True)
class UrlRule:
    pattern: str
    replacement: str
    removes_parameter: bool = False

    @classmethod
    def parse(cls, name: str, value: str) -> UrlRule:
        """``{pattern}: {replacement}``. RemoveParam takes a query parameter with the separator after it; a group named begin stays."""
        pattern, replacement = name.strip("{}"), value.strip("{}")
        if replacement != "RemoveParam":
            return cls(re.sub(r"\(\?P<", "(?<", pattern), re.sub(r"\\g<(\w+)>", r"${\1}", replacement))
        lazy = "?" if pattern.endswith(("*", "+")) else ""
        kept = "${begin}" if "(?P<begin>" in pattern else ""
        return cls(re.sub(r"\(\?P<", "(?<", pattern) + lazy + "(&|$)", kept, True)


def url_rules(text: str) -> list[UrlRule]:
    return [UrlRule.parse(name, value) for name, value in pairs(read_sections(text).get("UrlTransformations", []))]


def read_text(spark: SparkSession, path: str) -> str:
    """A configuration file as one string (bounded: these files are written by hand)."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""


JOB_NAME = r"^[a-z0-9][a-z0-9.-]{2,62}$"


@dataclass(frozen=True)
class JobLayout:
    """Names of a job's tables under one root."""

    root: str
    job: str

    def __post_init__(self):
        if not re.match(JOB_NAME, self.job.lower()):
            raise ValueError(f"not a job name: {self.job}")

    def path(self, table: str) -> str:
        if table not in ("crawled_urls", "failed_urls", "skipped_urls", "redirected_urls", "logs", "content", "frontier", "seen_urls", "state"):
            raise ValueError(f"not a table of a job: {table}")
        return f"{self.root.rstrip('/')}/{self.job.lower()}/{table}"

    def destroy(self, spark: SparkSession) -> bool:
        """Delete everything of the job; whether there was anything."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{self.job.lower()}")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
