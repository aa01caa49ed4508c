"""Rules over queries, paths and texts as Column expressions: weights, modes, predicates, tags, highlights, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tokens

#: Phrases of a query that asks for an implementation.
IMPLEMENTATION_PHRASES = (
    "implementation", "how does", "how is", "where is", "code for", "function that", "method that", "class that", "implements",
    "defined", "definition", "source", "logic", "algorithm", "where", "find", "locate", "show me", "actual code",
)
#: Words that open a narrative query.
NARRATIVE = ("how", "what", "why", "when", "where", "explain", "describe")
#: Extensions of a language's files.
LANGUAGE_EXTENSIONS = {
    "python": (".py",), "typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx"), "go": (".go",), "rust": (".rs",), "java": (".java",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h"), "c": (".c", ".h"), "csharp": (".cs", ".csx"), "razor": (".cshtml", ".razor"), "xml": (".csproj", ".resx", ".config"),
}
#: Kinds and sources of memories.
MEMORY_KINDS, MEMORY_SOURCES = ("memory", "preference", "note", "policy", "chat"), ("memory", "chat")
#: Ends and beginnings of the names of secret settings.
SECRET_ENDS, SECRET_STARTS = ("API_KEY", "SECRET", "PASSWORD", "CREDENTIAL", "_TOKEN"), ("AUTH_",)
#: Phrases of an answer that is not sure.
HEDGES = (
    "i'm not sure", "i couldn't find", "insufficient context", "may be", "might be", "possibly", "it seems", "appears to",
    "i don't have enough", "unable to determine", "without more context",
)
#: Phrases and what they can be searched by; a table of more can be passed in their place.
PHRASES = {"true or false": ("boolean", "bool"), "true and false": ("boolean", "bool")}


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(_text(text))
    return _any([F.contains(low, F.lit(p)) for p in phrases])


def implementation_intent(text: Column) -> Column:
    return holds_any(text, IMPLEMENTATION_PHRASES)


def adaptive_weights(text: Column, dense: float = 1.0, vector: float = 1.0, lexical: float = 1.0) -> Column:
    """{dense, vector, lexical}: weights moved by up to 25, 25 and 20 percent: narrative and long queries towards the dense list,
    queries of identifiers (tokens with digits) towards the lexical ones."""
    toks = tokens.query_tokens(F.array(_text(text)))
    share = F.when(F.size(toks) > 0, F.size(F.filter(toks, lambda t: t.rlike("[0-9]"))) / F.size(toks)).otherwise(0.0)
    tells = F.contains(_text(text), F.lit("?")) | F.lower(F.trim(_text(text))).rlike("^(" + "|".join(NARRATIVE) + ")")
    delta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(tells, 0.6).otherwise(0.0) + F.when(F.size(toks) >= 8, 0.4).otherwise(0.0) - share))
    part = lambda base, way: F.round(base * (1 + way * delta), 6)
    return F.struct(part(dense, 0.25).alias("dense"), part(vector, -0.25).alias("vector"), part(lexical, -0.2).alias("lexical"))


def bounded_score(raw: Column, mode: str, weight: float = 1.0, n_tokens: Column | None = None, saturation: float = 12.0, k: int = 30, top: float = 20.0) -> Column:
    """A raw lexical score brought into bounds: ``raw`` (none), ``rrf``, ``tanh`` or ``tanh_adaptive`` (4 a token); 0 for none."""
    low, high = 1.0 / (k + 50), 1.0 / (k + 1)
    value = {
        "raw": raw,
        "rrf": low + F.least(raw, F.lit(top)) / top * (high - low),
        "tanh": F.tanh(raw / saturation),
        "tanh_adaptive": F.tanh(raw / (4.0 * F.greatest(F.lit(1), n_tokens if n_tokens is not None else F.lit(1)))),
    }[mode]
    return F.when(raw > 0, F.round(weight * value, 9)).otherwise(0.0)


def search_profile(text: Column) -> Column:
    """symbol, semantic or complex, by the number of words and question words."""
    words = F.size(F.filter(F.split(F.trim(_text(text)), r"\s+"), lambda w: w != ""))
    asks = holds_any(text, ("how", "why", "explain", "what does"))
    return F.when(words <= 2, "symbol").when(asks, "complex").when(words <= 8, "semantic").otherwise("complex")


#: Settings by profile: dense weight, lexical weight, symbol boost, search effort, limit.
PROFILES = {"symbol": (0.3, 0.7, 0.6, 64, 5), "semantic": (0.6, 0.4, 0.35, 128, 10), "complex": (0.7, 0.3, 0.2, 192, 15)}


def profile_setting(profile: Column, which: int) -> Column:
    out = F.lit(None)
    for name, values in PROFILES.items():
        out = F.when(profile == name, F.lit(values[which])).otherwise(out)
    return out


def language_matches(language: Column, path: Column) -> Column:
    """Whether a path ends as a file of the language does."""
    low = F.lower(_text(path))
    fits = [(F.lower(language) == g) & _any([F.endswith(low, F.lit(e)) for e in ends]) for g, ends in LANGUAGE_EXTENSIONS.items()]
    return F.coalesce(_any(fits), F.lit(False))


def memory_like(path: Column, kind: Column, source: Column) -> Column:
    return (_text(path) == "") | F.lower(_text(kind)).isin(*MEMORY_KINDS) | F.lower(_text(source)).isin(*MEMORY_SOURCES)


def memory_penalty(query: Column, is_memory: Column, overlap: Column) -> Column:
    """-0.15 for a memory that the query does not ask for, -0.5 more where no token is shared."""
    asked = F.contains(F.lower(_text(query)), F.lit("memory"))
    return F.when(is_memory & ~asked, F.lit(-0.15) - F.when(overlap == 0, 0.5).otherwise(0.0)).otherwise(0.0)


def secret_key(name: Column) -> Column:
    up = F.upper(_text(name))
    return _any([F.endswith(up, F.lit(e)) for e in SECRET_ENDS] + [F.startswith(up, F.lit(s)) for s in SECRET_STARTS])


def rooted_path(path: Column, root: str = "/work") -> Column:
    """A folder as it stands below the root: separators, doubled and outer ones mended."""
    p = F.regexp_replace(F.regexp_replace(F.trim(_text(path)), r"\\", "/"), "/+", "/")
    inner = F.regexp_replace(p, "^/|/$", "")
    return F.when(inner == "", root).when((inner == root.strip("/")) | F.startswith(inner, F.lit(root.strip("/") + "/")), F.concat(F.lit("/"), inner)).otherwise(F.concat(F.lit(root + "/"), inner))


def matches_expected(path: Column, expected: Column) -> Column:
    """A file expectation (with an extension) by the path's end, a folder by a whole part of the path or its end."""
    p = F.regexp_replace(_text(path), r"\\", "/")
    e = F.regexp_replace(F.trim(_text(expected)), "^/+|/+$", "")
    part = F.contains(p, F.concat(F.lit("/"), e, F.lit("/")))
    return (p != "") & (e != "") & (F.endswith(p, e) | (part & ~e.rlike(r"[^/]\.[^./]+$")))


def hedges(text: Column) -> Column:
    return holds_any(text, HEDGES)


def code_references(text: Column) -> Column:
    """Fenced blocks and inline code."""
    return F.regexp_count(_text(text), F.lit("```[\\s\\S]*?```")) + F.regexp_count(_text(text), F.lit("`[^`]+`"))


def covered_share(text: Column, topics: Column) -> Column:
    """The share of topics that a text names; 1 without topics."""
    low = F.lower(_text(text))
    return F.when(F.size(topics) == 0, 1.0).otherwise(F.round(F.size(F.filter(topics, lambda t: F.contains(low, F.lower(t)))) / F.size(topics), 6))


def dense_text(mode: str, info: Column, tags: Column, code: Column, most: int = 8_000) -> Column:
    """What is embedded of a chunk: ``info``, ``code`` or both with tags; line numbers are left out, so that a move changes nothing."""
    plain = F.regexp_replace(_text(info), r" lines [0-9]+-[0-9]+\.", ".")
    chosen = {"info": plain, "code": _text(code), "info+code": F.concat_ws("\n", plain, F.nullif(F.array_join(tags, " "), F.lit("")), _text(code))}[mode]
    return F.substring(chosen, 1, most)


def heuristic_tags(symbol: Column, imports: Column, calls: Column) -> Column:
    """Up to ten tags: parts of the symbol, roots of the first six imports, the first four calls; lower case, distinct, in order."""
    none = F.array().cast("array<string>")
    roots = F.transform(F.slice(F.coalesce(imports, none), 1, 6), lambda i: F.lower(F.get(F.split(i, r"\."), F.lit(0))))
    called = F.filter(F.transform(F.slice(F.coalesce(calls, none), 1, 4), F.lower), lambda c: F.length(c) > 2)
    every = F.concat(tokens.ident_tokens(symbol, True), roots, called)
    return F.slice(F.array_distinct(F.filter(every, lambda t: F.length(t) > 1)), 1, 10)


def memory_highlights(text: Column, words: list[str], around: int = 30) -> Column:
    """For up to three words the text around their first occurrence, with every occurrence there marked; words not found give none."""
    import re

    out = []
    for w in [x for x in words if len(x) > 2][:3]:
        at = F.instr(F.lower(_text(text)), F.lit(w.lower()))
        piece = F.substring(_text(text), F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + len(w) + around)
        out.append(F.when(at > 0, F.concat(F.lit("..."), F.regexp_replace(piece, f"(?i){re.escape(w)}", "<<$0>>"), F.lit("..."))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def phrase_versions(text: Column, phrases: dict[str, tuple[str, ...]] | None = None, most: int = 2) -> Column:
    """The lower-cased query with each known phrase replaced by up to ``most`` of its synonyms; distinct, in order."""
    low = F.lower(_text(text))
    made = [F.when(F.contains(low, F.lit(p)), F.replace(low, F.lit(p), F.lit(s))) for p, more in (phrases or PHRASES).items() for s in more[:most]]
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull() & (x != low)))


def material_drop(before: Column, now: Column, share: float = 0.5, least: float = 10) -> Column:
    """Whether a count of at least ``least`` fell below ``share`` of itself."""
    return F.coalesce((before >= least) & (now < before * share), F.lit(False))


def search_effort(complexity: Column, low: int = 64, high: int = 512) -> Column:
    """How far an index is searched for a query of the given complexity."""
    return F.round(low + (high - low) * complexity).cast("int")


def repo_hint(text: Column) -> Column:
    """A repository named in a request by ``repo x`` or ``in the x repo``; empty without one."""
    t = F.lower(_text(text))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"\brepo[: ]+([\w./-]+)", 1), F.lit("")), F.regexp_extract(t, r"\bin (?:the )?([\w./-]+) repo\b", 1))


def full_extension(path: Column) -> Column:
    """The extension of a file with that before it, as in d.ts or test.js; the last one alone where there is no other."""
    return F.lower(F.regexp_extract(F.regexp_extract(_text(path), r"([^/\\]*)$", 1), r"^[^.]+\.((?:[\w-]+\.)?[\w-]+)$", 1))


def citations(text: Column) -> Column:
    """Distinct ``path:line`` citations of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"([\w./-]+\.[a-z]+):[0-9]+"), 1)))
