"""Columns over paths, names and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of files by name, the first match counts: fixed values.
CATEGORIES = (
    ("LOCKFILE", r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|gradle\.lockfile|cargo\.lock|poetry\.lock)$"),
    ("MIGRATION", r"(^|/)(migrations?|db/migrate|flyway|liquibase)/|(^|/)v[0-9][0-9._]*__[^/]*\.sql$"),
    ("CI", r"(^|/)\.github/workflows/|(^|/)(\.gitlab-ci\.yml|jenkinsfile|azure-pipelines\.yml)$|(^|/)\.circleci/"),
    ("CONTAINER", r"(^|/)(dockerfile[^/]*|[^/]*\.dockerfile|docker-compose[^/]*\.ya?ml|compose\.ya?ml)$"),
    ("BUILD", r"(^|/)(pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?|package\.json|cargo\.toml|makefile|tsconfig[^/]*\.json)$"),
    ("CONFIG", r"\.(ya?ml|toml|ini|conf|properties|env)$"),
    ("RESOURCE", r"\.(json|xml|sql|html|css|txt|csv|svg|graphql|proto)$"),
)
LANGUAGES = {"java": "java", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}


def rejection(path: str) -> Column:
    """Why a path is refused, the first reason in order; null if it is fine."""
    p = F.col(path)
    part = r"(^|/)(\.|\.\.)?(/|$)"
    return (
        F.when(p == "", "Empty")
        .when(p.startswith("/") | p.rlike(r"^[A-Za-z]:"), "Absolute")
        .when(p.rlike("[\\x00-\\x1f\\x7f]"), "ControlCharacter")
        .when(p.contains("\\"), "Backslash")
        .when(p.rlike(part), "NonNormalComponent")
        .when(F.lower(p).rlike(r"(^|/)\.git(/|$)"), "GitDirectory")
    )


def category(path: str) -> Column:
    out = None
    for name, pattern in CATEGORIES:
        hit = F.lower(path).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def extension(path: str) -> Column:
    """What follows the last dot of the file's name; empty without one."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(extension(path))]


#: Source languages that are not analysed, by extension: fixed values.
UNREAD = {"py": "Python", "go": "Go", "rs": "Rust", "kt": "Kotlin", "kts": "Kotlin", "scala": "Scala", "groovy": "Groovy", "rb": "Ruby", "php": "PHP", "cs": "C#", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "swift": "Swift", "m": "Objective-C", "vue": "Vue", "svelte": "Svelte", "dart": "Dart"}


def unread_language(path: str) -> Column:
    """The language of source code that is not analysed; null for other files."""
    return F.create_map(*[F.lit(x) for kv in UNREAD.items() for x in kv])[F.lower(extension(path))]


def owner_and_name(symbol: str) -> tuple[Column, Column]:
    """The owner and the name of a member's id `owner#name(parameters)`."""
    return F.substring_index(symbol, "#", 1), F.regexp_extract(symbol, r"#([^(#]*)", 1)


def location(file: str, start: str, end: str) -> Column:
    return F.concat(F.col(file), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def without_controls(text: str) -> Column:
    """Control characters that a terminal would obey as visible escapes; line ends and tabs stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "?")


def workflow_data(text: str) -> Column:
    """Text inside a workflow command: per cent signs and line ends are encoded."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def path_uri(path: str) -> Column:
    """A path as a URI: its components are encoded, its slashes stay."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def excluded(path: str) -> Column:
    return F.array_contains(F.split(path, "/"), "node_modules") | F.col(path).endswith(".min.js") | F.col(path).endswith(".bundle.js")


def parent_dir(path: str) -> Column:
    """The directory as a module, '.' at the root."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def short_label(symbol: str) -> Column:
    """What follows the last of # : / and . before any parameters."""
    return F.regexp_extract(symbol, r"([^#:/.(]+)(?:\(.*)?$", 1)


def failure_fingerprint(kind: str, message: str) -> Column:
    """The kind and the message's first line, 200 characters at most."""
    return F.substring(F.concat(F.col(kind), F.lit(": "), F.element_at(F.split(message, "\n"), 1)), 1, 200)


def token_fingerprint(tokens: str) -> Column:
    """A hash of tokens, each with its length before it: token borders count."""
    return F.md5(F.concat_ws("", F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))))


def merged_fingerprint(place: str, fingerprint: str) -> Column:
    """An aggregate: the hash of a group's fingerprints in the order of their places."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, fingerprint))), lambda x: x[fingerprint]), ""))


def joined_relative(directory: str, relative: str) -> Column:
    """directory/relative with . and .. taken in; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", directory, relative), "/"), lambda x: (x != "") & (x != "."))
    none = F.lit(None).cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return F.when(stack.isNull(), none).when(part != "..", F.concat(stack, F.array(part))).when(F.size(stack) == 0, none).otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))

    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")


def glob_regex(glob: str) -> str:
    """An anchored regular expression: * and ? stay in a component, ** spans them, {a,b} and [..] are choices, a backslash escapes."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob[i : i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 2
            elif glob[i : i + 2] == "**":
                out, i = out + ".*", i + 1
            else:
                out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += "\\" + c if c in r".^$+()|[]{}\*?" else c
        i += 1
    return f"^{out}$"


def owners_regex(pattern: str) -> str:
    """An ownership pattern: anchored if it has a slash before its end; what it names owns all below it; dir/ only what is below, dir/* only the direct children."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    core = glob_regex(body)[1:-1]
    if pattern.endswith("/"):
        tail = "/.*"
    elif body.endswith("/*"):
        tail = ""
    else:
        tail = "(?:/.*)?"
    return ("^" if anchored else "^(?:.*/)?") + core + tail + "$"
