"""Problem 8: template residue and error-page text.

Records are stripped of what they only quote (code, block quotes, passages in quotation marks) and cut into passages. A
naive Bayes model is learned from positive and unlabelled passages: passages that match a short list of well-known
messages and placeholder forms are trusted positives, all others are unlabelled. Expectation-maximization starts
with each unlabelled passage at the share of trusted ones in its record, as the parts of an error page stand together;
each round scores every passage of the corpus; its posterior of lying over the threshold weighs the counts of the next round and the class prior, and
the rounds end when the expected number of positives hardly changes. A record is residue if any of its passages scores
over the threshold.

Features (words and shapes, and pairs of them) are hashed into 2**18 buckets, so the model
has a fixed size whatever the corpus; counts are summed per task before they are shuffled, and every passage takes part in
every round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1 << 18
#: Most rounds, change of the expected positives that ends them, smoothing, log odds over which a passage is residue.
ROUNDS, LEAST_CHANGE, SMOOTHING, THRESHOLD = 8, 0.005, 0.1, 10.0
#: Tokens of a window: longer passages are scored in windows that overlap by half, so none is diluted by its length.
WINDOW = 200

#: Placeholder forms of common template languages.
PLACEHOLDER = re.compile(
    r"\$\{[^{}\n]+\}|\{\{[^{}\n]+\}\}|<<[^<>\n|]+>>|%%[^%\n]+%%|@@[^@\n]+@@|#\{[^{}\n]+\}|\{%[^%\n]+%\}"
    r"|(?<![\w\])])\[(?:[A-Z][A-Z_ ]{2,}|(?i:insert|your|enter|add) [^\[\]\n]+|[A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z]\w+)\](?!\()|\{[A-Za-z][A-Za-z_ ]{2,}\}|__[A-Za-z]+(?:[_ ][A-Za-z]+)*__"
)
#: Of these every placeholder holds at least one.
MARKS = ("{", "<<", "%%", "@@", "[", "__")

#: Well-known messages of servers, sites and template engines, filler and demands for scripts that are trusted positives.
SEEDS = (
    # status lines, alone or with their number or a reason
    r"^\W*(?:error|http)?\W*(?:[45]\d\d)?\W*(?:page not found|not found|forbidden|access denied|bad gateway|bad request|unauthorized|internal server error|gateway time-?out|too many requests|session (?:has )?expired)\W*(?:[45]\d\d)?\W*$",
    r"^\W*(?:[45]\d\d)?\W*service (?:temporarily )?unavailable\b",
    r"^\W*(?:erreur|fehler|error|エラー) ?[45]\d\d\b",
    r"^\W*(?:页面(?:不存在|未找到|找不到)|找不到(?:该|您|页面)|服务器(?:内部)?错误|没有权限访问|ページが見つかりません|サーバーエラー|アクセスが拒否)",
    r"^\W*(?:seite nicht gefunden|zugriff verweigert|interner serverfehler|page introuvable|accès refusé|página no encontrada|acceso denegado|error interno del servidor)\b",
    # messages of sites, databases and template engines
    r"^\W*(?:oops\W+)?something went wrong\b",
    r"^\W*error establishing a\b",
    r"^\W*checking your browser before\b",
    r"^\W*(?:notice|warning|fatal error|parse error): .* on line \d+\W*$",
    r"^\W*\[object object\]",
    # demands for scripts
    r"\b(?:enable|activate|allow|turn on|switch on) (?:java)?scripts?\b|\bjavascript is (?:disabled|required|not enabled)|\b(?:needs?|requires?) (?:javascript|scripts? (?:to be )?(?:switched|turned) on)\b|^\W*noscript\b",
    r"\b(?:aktivieren sie|activer|active|activar|habilite|habilitar) javascript\b|javascript ?を有効|(?:启用|開啟) ?javascript",
    # filler
    r"\basdf\b.*\basdf\b|\bx{3,}(?: x{3,}){2,}|\bblah(?: blah){2,}|^\W*(?:sample|dummy|placeholder|filler) text\W*$",
    r"\b(?:add|enter|insert|with) your (?:own )?(?:text|content|title|description)\b|\bgoes here\W*$|^\W*(?:write|enter|insert|add|put) .*\byour \w+ here\b",
)
#: Of these every alternative of SEEDS holds at least one; a passage without any is not searched.
STEMS = (
    "found", "forbidden", "denied", "gateway", "request", "unauthorized", "server", "expired", "unavailable", "erreur", "fehler", "error", "エラー", "页面", "找不到", "服务器", "没有权限", "ページ", "サーバー", "アクセス",
    "gefunden", "verweigert", "introuvable", "refusé", "encontrada", "denegado", "wrong", "establishing", "browser", "on line", "[object", "script", "asdf", "xxx", "blah", "text", "your", "goes here",
)
#: Words of the usual filler text.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim laborum nunc nibh erat cras donec dictum mollis purus justo ligula augue porta pulvinar massa turpis sapien felis ornare arcu vitae tempor".split())

_FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~)[^\n]*$")
_BLOCK = re.compile(r"(?m)^[ \t]*>[^\n]*$")
_QUOTED = re.compile(r"`[^`\n]+`|\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|「[^」\n]+」|『[^』\n]+』")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。!?])")
_ASCII_TOKEN = re.compile(r"\x02|\x03|https?://\S+|\w+")
_CAMEL = re.compile("[a-z][A-Z]")
_TOKEN = re.compile(r"\x02|\x03|https?://\S+|[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])\w)+")
_WORDS = re.compile(r"[^\W\d_]+")
_GREETING = re.compile(r"(?i)\W*(?:dear|hello|hi|maintained by)\b")


def own_text(text: str) -> str:
    """The text without what it quotes: fenced and inline code, block quotes, passages in quotation marks."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    fences = list(_FENCE.finditer(text)) if "```" in text or "~~~" in text else []
    if fences:
        spans, inside = [], False
        if len(fences) % 2 and fences[0][0].strip() in ("```", "~~~"):
            before = text[: fences[0].start()].rstrip()
            inside = bool(before) and bool(re.search(r"[;{}():\]]$|\breturn\b[^\n]*$", before))  # the text begins within code
        keep_from = 0
        for f in fences:
            if inside:
                inside, keep_from = False, f.end()
            else:
                spans.append(text[keep_from : f.start()])
                inside = True
        if not inside:
            spans.append(text[keep_from:])
        text = "\n".join(spans)
    if ">" in text:
        text = _BLOCK.sub("", text)
    return _QUOTED.sub(" \x03 ", text)


def passages(text: str) -> list[str]:
    """Sentences and lines of the text's own words."""
    return [part for line in own_text(text).split("\n") if line for piece in _SENTENCES.split(line) if (part := piece.strip())]


def _seed_pattern(seeds: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?i)" + "|".join(seeds))


def is_trusted(passage: str, pattern: re.Pattern | None = None) -> bool:
    """Whether a passage is a well-known message, filler, or little but placeholders."""
    low = passage.lower()
    if "\x03" not in passage and any(s in low for s in STEMS) and (pattern or _SEED_PATTERN).search(passage):
        return True
    words = _WORDS.findall(low)
    if len(words) >= 4 and sum(w in FILLER for w in words) >= 0.75 * len(words):
        return True
    if not any(m in passage for m in MARKS):
        return False
    holes = [h for h in PLACEHOLDER.findall(passage) if not h.startswith("__")]
    rest = len(_WORDS.findall(PLACEHOLDER.sub(" ", passage)))
    return len(holes) >= 2 and rest <= 8 or len(holes) == 1 and (rest == 0 or bool(_GREETING.match(passage)) and rest <= 3)


_SEED_PATTERN = _seed_pattern(SEEDS)


def _shape(t: str) -> str:
    """What a token counts as: itself in lower case, or the kind of a placeholder, quotation, number, address, name or run."""
    if t == "\x02":
        return "<hole>"
    if t == "\x03":
        return "<quote>"
    if t.isdigit():
        return "0"
    if t.startswith(("http://", "https://")):
        return "<url>"
    if any(c.isdigit() for c in t):
        return "<mix>"
    if "_" in t or not t.islower() and _CAMEL.search(t) and t.lower() != "javascript":
        return "<name>"
    if len(t) >= 3 and len(set(t.lower())) == 1:
        return "<run>"
    return t.lower()


class Featurizer:
    """Feature buckets of passages; tokens are hashed once and remembered up to a bound."""

    KEPT = 200_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.edge = (self._hash("<s>"), self._hash("</s>"))
        self.number, self.quote = self._hash("0"), self._hash("<quote>")

    @staticmethod
    def _hash(x: str) -> int:
        return xxhash.xxh64_intdigest(x) >> 1

    def _code(self, t: str) -> int:
        if (h := self.known.get(t)) is None:
            h = self._hash(_shape(t))
            if len(self.known) < self.KEPT:
                self.known[t] = h
        return h

    def windows(self, passage: str) -> list[list[int]]:
        """Token codes of a passage, or of its windows if it is long."""
        if any(m in passage for m in MARKS):
            passage = PLACEHOLDER.sub(" \x02 ", passage)
        found = (_ASCII_TOKEN if passage.isascii() else _TOKEN).findall(passage)
        code, known = self._code, self.known
        codes = [known.get(t) or code(t) for t in found]
        if all(c == self.number for c in codes):
            return []
        if len(codes) <= WINDOW:
            return [codes]
        return [codes[i : i + WINDOW] for i in range(0, len(codes) - WINDOW // 2, WINDOW // 2)]

    def buckets(self, windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets of all windows in a row, how many each window has)."""
        n = len(windows)
        size = np.fromiter((len(w) for w in windows), np.int64, n)
        total = int(size.sum()) + 2 * n
        flat, owner = np.empty(total, np.uint64), np.repeat(np.arange(n), size + 2)
        first = np.cumsum(size + 2) - size - 2
        inner = np.ones(total, bool)
        inner[first] = inner[first + size + 1] = False
        flat[first], flat[first + size + 1] = self.edge
        flat[inner] = np.fromiter((c for w in windows for c in w), np.uint64, int(size.sum()))
        pair = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        same = owner[:-1] == owner[1:]
        value = np.r_[flat[inner], (pair ^ (pair >> np.uint64(31)))[same]]
        who = np.r_[owner[inner], owner[:-1][same]]
        bucket = (((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)
        key = np.unique(who * BUCKETS + bucket)
        return (key % BUCKETS).astype("<i4"), np.bincount(key // BUCKETS, minlength=n).astype("<i4")


def passage_rows(ids: list, texts: list[str], features: Featurizer, pattern: re.Pattern | None = None) -> pd.DataFrame:
    """(doc_id, trusted, sizes, buckets): of each record the packed features of its passages, in order; trusted is 1 for a
    trusted positive, 2 for a passage that speaks about something it quotes."""
    windows, trusted, counts = [], [], []
    for text in texts:
        before, found = len(windows), passages(text)
        for p in found:
            if w := features.windows(p):
                windows += w
                trusted += [2 if "\x03" in p else int(is_trusted(p, pattern))] * len(w)
        counts.append(len(windows) - before)
    if not windows:
        return pd.DataFrame({"doc_id": [], "trusted": [], "sizes": [], "buckets": []})
    flat, sizes = features.buckets(windows)
    ends, at = np.cumsum(sizes), np.cumsum(counts)
    raw, raw_sizes, raw_trusted = flat.tobytes(), sizes.tobytes(), np.array(trusted, np.uint8).tobytes()
    rows = []
    for i, hi, n in zip(ids, at.tolist(), counts, strict=True):
        if n:
            lo = hi - n
            rows.append((i, raw_trusted[lo:hi], raw_sizes[4 * lo : 4 * hi], raw[4 * int(ends[lo - 1]) if lo else 0 : 4 * int(ends[hi - 1])]))
    return pd.DataFrame(rows, columns=["doc_id", "trusted", "sizes", "buckets"])


def passage_table(documents: DataFrame, id_col: str, text_col: str, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(doc_id, trusted, sizes, buckets) of all records with a passage."""
    picked = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, pattern = Featurizer(), _seed_pattern(seeds)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                yield passage_rows(part["doc_id"].tolist(), part["_text"].tolist(), features, pattern)

    return picked.mapInPandas(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, trusted binary, sizes binary, buckets binary")


class ResidueModel:
    """Log odds of the buckets and of the class."""

    def __init__(self, odds: np.ndarray, bias: float) -> None:
        self.odds, self.bias = odds, bias


class _Batch:
    """The unpacked passages of a batch of records."""

    def __init__(self, batch: pd.DataFrame) -> None:
        self.buckets = np.frombuffer(b"".join(batch["buckets"]), "<i4")
        sizes = np.frombuffer(b"".join(batch["sizes"]), "<i4")
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        mark = np.frombuffer(b"".join(batch["trusted"]), np.uint8)
        self.trusted, self.open = (mark == 1).astype(float), (mark != 2).astype(float)
        count = np.fromiter((len(t) for t in batch["trusted"]), np.int64, len(batch))
        self.n, self.record, self.count = len(sizes), np.repeat(np.arange(len(batch)), count), count

    def scores(self, odds: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, weights=odds[self.buckets], minlength=self.n) + bias

    def weights(self, model: ResidueModel | None, threshold: float) -> np.ndarray:
        """Weights as positives: 1 for trusted passages, 0 for those that quote; for the others the posterior of lying over the
        threshold, in the first round the share of trusted passages in the record."""
        if model is None:
            share = (np.bincount(self.record, weights=self.trusted, minlength=len(self.count)) / np.maximum(self.count, 1))[self.record]
        else:
            share = 1 / (1 + np.exp(-np.clip(self.scores(model.odds, model.bias) - threshold, -50, 50)))
        return np.maximum(self.trusted, share * self.open)


def _counts(table: DataFrame, model: ResidueModel | None, threshold: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Counts by bucket of positives and of all passages, the expected positives and all passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positive, total = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last entry counts passages
        for batch in batches:
            if not len(batch):
                continue
            b = _Batch(batch)
            weight = b.weights(model, threshold)
            positive[:-1] += np.bincount(b.buckets, weights=weight[b.owner], minlength=BUCKETS)
            total[:-1] += np.bincount(b.buckets, minlength=BUCKETS)
            positive[-1] += weight.sum()
            total[-1] += b.n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "positive": positive[used], "total": total[used]})

    summed = table.mapInPandas(run, "bucket int, positive double, total double").groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total")).toPandas()
    positive, total = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # at most BUCKETS + 1 rows: the bound of the model
    positive[summed["bucket"]], total[summed["bucket"]] = summed["positive"], summed["total"]
    return positive[:-1], total[:-1], positive[-1], total[-1]


def _model(positive: np.ndarray, total: np.ndarray, n_positive: float, n: float, smoothing: float) -> ResidueModel:
    """Both classes are smoothed towards the whole corpus, so that a bucket unseen among positives counts mildly against."""
    negative = total - positive
    whole = (total + 0.5) / (total.sum() + 0.5 * BUCKETS)
    p, q = positive.sum(), negative.sum()
    mass = smoothing * max(p, 1.0)
    odds = np.log((positive + mass * whole) / (p + mass)) - np.log((np.maximum(negative, 0) + mass * whole) / (q + mass))
    prior = min(max((n_positive + 1) / (n + 2), 1e-6), 0.5)
    return ResidueModel(odds, float(np.log(prior / (1 - prior))))


def fit_residue_model(table: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> ResidueModel:
    """The model of the passages of ``passage_table``; the class prior is estimated anew in each round."""
    positive, total, n_positive, n = _counts(table, None, threshold)
    model = _model(positive, total, n_positive, n, smoothing)
    for _ in range(rounds):
        positive, total, expected, n = _counts(table, model, threshold)
        model = _model(positive, total, expected, n, smoothing)
        if abs(expected - n_positive) <= LEAST_CHANGE * max(expected, 1.0):
            break
        n_positive = expected
    return model


def residue_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, smoothing: float = SMOOTHING, seeds: tuple[str, ...] = SEEDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, residue_passages, passages): the highest log odds of a record's passages, and how many are residue.

    Records with a null id are left out; null, empty and blank texts and those without a token have no row. Repeated rows
    count together. Trusted passages are residue whatever they score; without any, nothing is. Other columns are not read.
    """
    table = cut_lineage(passage_table(documents, id_col, text_col, seeds))
    some = not table.where(F.contains("trusted", F.lit(b"\x01"))).isEmpty()
    model = fit_residue_model(table, rounds, smoothing, threshold) if some else ResidueModel(np.full(BUCKETS, -1.0), -10.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = _Batch(batch)
                s = b.scores(model.odds, model.bias)
                best = np.full(len(batch), -np.inf)
                np.maximum.at(best, b.record, s)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": best, "hits": np.bincount(b.record, weights=(s > threshold) | (b.trusted > 0), minlength=len(batch)).astype(np.int64), "n": b.count})

    scored = table.mapInPandas(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double, hits bigint, n bigint")
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.sum("hits").alias("residue_passages"), F.sum("n").alias("passages"))


def residue_records(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit: float) -> DataFrame:
    """(doc_id) of records that hold residue in place of content."""
    return residue_scores(documents, id_col, text_col, **fit).where("residue_passages > 0").select(F.col("doc_id").alias(id_col))
