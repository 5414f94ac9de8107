"""Language and category of a file by its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and those that hold program sources.
LANGUAGES = {
    ".java": "Java", ".kt": "Kotlin", ".scala": "Scala", ".groovy": "Groovy", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".rb": "Ruby", ".go": "Go",
    ".rs": "Rust", ".cs": "C#", ".php": "PHP", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".properties": "Properties", ".toml": "TOML", ".ini": "INI", ".md": "Markdown", ".txt": "Text",
    ".gradle": "Gradle", ".html": "HTML", ".jsp": "JSP", ".c": "C", ".h": "C", ".cpp": "C++",
}
SOURCES = ("Java", "Kotlin", "Scala", "Groovy", "TypeScript", "JavaScript", "Python", "Ruby", "Go", "Rust", "C#", "PHP", "C", "C++", "JSP")


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def category(path: Column) -> Column:
    """What a file is for; the first rule that fits counts."""
    steps, base, low, ext = F.split(path, "/"), F.regexp_extract(path, "([^/]*)$", 1), F.lower(path), extension(path)
    has = lambda *names: F.arrays_overlap(steps, F.array(*(F.lit(n) for n in names)))
    return (
        F.when(has("migration", "migrations") | base.rlike(r"^v\d+__"), "migration")
        .when((ext == ".sql") & base.rlike("(?i)schema|seed|ddl"), "schema")
        .when(has("test", "tests", "__tests__") | base.rlike(r"\.(?:test|spec)\.[a-z]+$"), "test")
        .when(ext.isin(".md", ".txt") | (base == "LICENSE"), "documentation")
        .when(base.isin("pom.xml", "build.gradle", "package.json", "Makefile") | (ext == ".gradle"), "build")
        .when(ext.isin(".sh", ".bash") | base.isin("Dockerfile", "Procfile"), "script")
        .when(ext.isin(".properties", ".yaml", ".yml", ".toml", ".ini", ".env") | (base == "application.xml") | low.contains("/config/") | low.endswith(".conf"), "configuration")
        .when(low.contains("/generated/") | low.contains("/target/") | low.contains("/build/"), "generated")
        .when(F.coalesce(language(path).isin(*SOURCES), F.lit(False)), "source")
        .when(ext.isin(".xml", ".json"), "configuration")
        .otherwise("other")
    )
