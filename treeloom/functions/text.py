"""Lines, tokens and paths of source text as column expressions, with the string rules of the stored data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def split_lines(text: Column) -> Column:
    """Lines at every kind of line break, without an empty last one; an empty text has none."""
    parts = F.split(text, _BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_range(lines: Column, start: Column, stop: Column) -> Column:
    """Lines start..stop, both counted from 1, as far as they exist."""
    first, n = F.greatest(start, F.lit(1)), F.size(lines)
    return F.when((stop < first) | (first > n), F.array().cast("array<string>")).otherwise(F.slice(lines, first, F.least(stop, n) - first + 1))


def indentation(line: Column) -> Column:
    return F.regexp_extract(line, r"^(\s*)", 1)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Folder of a path, the empty string at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot; none for names that begin or end with their only dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")).isin("", "."), name).otherwise(F.concat_ws("/", folder, name))


def normal_path(path: Column) -> Column:
    """Without ``.`` and with ``..`` taking the folder before it away; ``..`` above the top is dropped."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.array_append(acc, part))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


#: File names and suffixes of each language.
LANGUAGE_SUFFIXES = {
    "python": ".py", "javascript": ".js .jsx", "typescript": ".ts", "tsx": ".tsx", "java": ".java", "go": ".go", "rust": ".rs", "cpp": ".cpp .cc .cxx", "c": ".c .h", "csharp": ".cs", "php": ".php", "ruby": ".rb",
    "kotlin": ".kt .kts", "swift": ".swift", "scala": ".scala", "html": ".html .htm", "css": ".css", "json": ".json", "yaml": ".yaml .yml", "xml": ".xml", "toml": ".toml", "markdown": ".md .markdown",
}
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Containerfile": "dockerfile", "README": "markdown", "LICENSE": "unknown", "Makefile": "unknown", "Jenkinsfile": "unknown"}


def language(path: Column) -> Column:
    """Language of a path: by whole name, then by lower-case suffix, else unknown."""
    by_suffix = F.create_map(*[F.lit(x) for lang, all_ in LANGUAGE_SUFFIXES.items() for s in all_.split() for x in (s, lang)])
    by_name = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(by_name, file_name(path)), F.try_element_at(by_suffix, F.lower(suffix(path))), F.lit("unknown"))


def is_test_path(path: Column) -> Column:
    """Whether a path belongs to tests, by a folder name or the file name, whatever the case and slashes."""
    p = F.lower(F.translate(path, "\\", "/"))
    name = file_name(p)
    folder = F.arrays_overlap(F.split(p, "/"), F.array(F.lit("test"), F.lit("tests"), F.lit("__tests__")))
    return F.coalesce(folder | name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.") | name.contains(".spec."), F.lit(False))


#: Words that make a question one about tests (ranking; context, which knows one more) or about behaviour.
TEST_WORDS = "test tests testing tested pytest unittest coverage fixture fixtures mock mocks mocking spec specs".split()
TEST_WORDS_CONTEXT = [*TEST_WORDS, "mocked"]
BEHAVIOUR_WORDS = "how flow flows work works working call calls called request requests process processes execute executes execution handle handles handled trace traces".split()


def asks(question: Column, words: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(word_tokens(question), F.array(*[F.lit(w) for w in words])), F.lit(False))
