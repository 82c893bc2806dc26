"""Text functions: tokens, digests, URLs and references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUNCTUATION = ".,:;!?()[]{}\"'`/\\-_*+=<>|~@#$%^&"
HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def words_of(line: Column) -> Column:
    """Runs of letters and digits, two characters at least, not all digits."""
    runs = F.regexp_extract_all(line, F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    return F.filter(runs, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def lexical_tokens(text: Column) -> Column:
    """Words and pairs of neighbouring words of each line."""

    def line_tokens(line: Column) -> Column:
        w = words_of(line)
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))

    return F.flatten(F.transform(F.split(F.lower(text), "\n"), line_tokens))


def message_tokens(message: Column) -> Column:
    """Lower-case words without the punctuation around them."""
    parts = F.split(F.lower(message), r"\s+")
    marks = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"^{marks}+|{marks}+$", "")), lambda p: p != "")


def label_tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words of four characters at least, no stop words."""
    words = message_tokens(text)
    keep = lambda w: (F.length(w) >= 4) & (~w.isin(*stop_words) if stop_words else F.lit(True))
    return F.filter(words, keep)


def path_tokens(path: Column, stop: tuple[str, ...] = ("src", "lib", "internal", "test")) -> Column:
    """Parts of a path without the extension, three characters at least."""
    bare = F.regexp_replace(F.lower(path), r"\.[^./]*$", "")
    return F.filter(F.split(bare, r"[/_.\-]+"), lambda p: (F.length(p) >= 3) & ~p.isin(*stop))


def normalize_diff(diff: Column) -> Column:
    """Hunk headers without numbers, blanks collapsed, identifiers in lower case (X11)."""

    def line(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, "[ \t]+", " "), " ", -1)
        low = F.transform(parts, lambda t: F.when(t.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lower(t)).otherwise(t))
        return F.array_join(low, " ")

    return F.array_join(F.transform(F.split(F.regexp_replace(diff, HUNK, "@@@@"), "\n", -1), line), "\n")


def format_stars(n: Column) -> Column:
    """Counts with K and M."""
    x = n.cast("double")
    return F.when(n >= 1_000_000, F.format_string("%.1fM", x / 1e6)).when(n >= 10_000, F.format_string("%.0fK", x / 1e3)).when(n >= 1_000, F.format_string("%.1fK", x / 1e3)).otherwise(n.cast("string"))


def repo_url(raw: Column, default_host: str = "github.com") -> Column:
    """Struct (host, owner, repo, provider) of a repository address; null parts where it has none."""
    first = F.substring_index(raw, "/", 1)
    full = F.when(raw.contains("://"), raw).when(first.rlike("[.:]"), F.concat(F.lit("https://"), raw)).otherwise(F.concat(F.lit(f"https://{default_host}/"), raw))
    host = F.lower(F.regexp_extract(full, r"^[^:]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    parts = F.split(path, "/")
    ok = F.size(parts) >= 2
    provider = (
        F.when(host == "gitlab.com", "gitlab").when(host == "codeberg.org", "gitea").when(host.contains("gitlab"), "gitlab")
        .when(host.rlike("gitea|forgejo|codeberg"), "gitea").otherwise("github")
    )
    owner = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.struct(host.alias("host"), F.when(ok, owner).alias("owner"), F.when(ok, F.regexp_replace(F.element_at(parts, -1), r"\.git$", "")).alias("repo"), provider.alias("provider"))


def pr_reference(ref: Column) -> Column:
    """Struct (owner, repo, number) of ``owner/repo#n`` or a pull request address."""
    short, url = r"^([^/#:]+)/([^#:]+)#(\d+)$", r"^https?://github\.com/([^/]+)/([^/]+)/pull/(\d+)(?:[/?#].*)?$"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(ref, short, i), F.lit("")), F.nullif(F.regexp_extract(ref, url, i), F.lit("")))
    return F.struct(pick(1).alias("owner"), pick(2).alias("repo"), pick(3).cast("int").alias("number"))


def remote_url(raw: Column) -> Column:
    """host/owner/repo of an ssh or http remote."""
    x = F.regexp_replace(raw, r"^[a-z+]+://(?:[^/@]*@)?|^[^/@]*@", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^([^/:]+):(?:\d+/)?", "$1/"), r"(\.git)?/*$", "")
    return F.lower(x)


def semantic_document(*sections: Column) -> Column:
    """Sections that are not empty, a blank line between."""
    return F.array_join(F.filter(F.array(*sections), lambda s: s.isNotNull() & (s != "")), "\n\n")
