"""Personal data: expressions for what has a fixed form, and a skip-chain conditional random field for the rest.

The field labels tokens that hold a digit or an at sign. Neighbouring tokens are linked in a chain; tokens of one
document with the same digits, or the same letters, are linked by skip edges however far apart they are. Loopy message
passing lets them share their labels. Tokens inside a match of the expressions are fixed to its kind. The weights are
trained on the corpus itself, with the matches as labels: counts of token features by label over all documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch, batches_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
FEATURES = 1 << 12
# Message passing ends when it has converged. A document that has not after so many rounds is reported.
ROUNDS = 2_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_AROUND = "\"'<>[]{},;:!?|*#$%&."


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters before it, and the domain behind it."""
    behind = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > behind and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            behind = domain.end()
            yield first, behind
        else:
            behind = max(behind, at + 1)
        at = text.find("@", max(at + 1, behind))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of each match, by start and kind. A match that fails its test is dropped."""
    found = [(first, 0, end) for first, end in _emails(text)]
    if _DIGIT_OR_AT.search(text):
        for match in _IP.finditer(text):
            parts = match.group().split(".")
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in parts):
                found.append((match.start(), 1, match.end()))
        for match in _CARD.finditer(text):
            if match.end() - match.start() <= 38:
                digits = match.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((match.start(), 2, match.end()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= sum(letter.isdigit() for letter in match.group()) <= 15:
                    found.append((match.start(), 3, match.end()))
    return sorted(found)


@dataclass
class Token:
    start: int
    end: int
    label: int | None  # fixed by an expression
    features: tuple[int, ...]
    form: str


def _hashed(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % FEATURES


def shape(token: str) -> str:
    """Digits as their number, letters as ``a``, other characters as they are: ``(843)`` becomes ``(3)``."""
    parts = (
        str(min(len(run), 24)) if run[0].isdigit() else "a" if run[0].isalpha() else run
        for run in re.findall(r"[0-9]+|[^\W\d_]+|[\W_]", token[:64])
    )
    return "".join(parts)[:24]


def form(token: str) -> str:
    """What equal or similar tokens share: the last ten digits where there are at least six, else the letters."""
    digits = "".join(letter for letter in token if "0" <= letter <= "9")
    return digits[-10:] if len(digits) >= 6 else token.lower()


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> list[Token]:
    """Tokens that can be personal data, in order, with their features: own shape, and the shapes on both sides.

    Tokens without digit or at sign have no evidence of their own and are always ``other``, so the field leaves them
    out; they still show in their neighbours' features.
    """
    found: list[Token] = []
    cover = 0
    matches = list(_TOKEN.finditer(text)) if _DIGIT_OR_AT.search(text) else []
    for place, match in enumerate(matches):
        word = match.group()
        if not _DIGIT_OR_AT.search(word):
            continue
        core = word.strip(_AROUND)
        if not core:
            continue
        start = match.start() + word.index(core)
        while cover < len(spans) and spans[cover][2] <= start:
            cover += 1
        label, near = None, cover
        while label is None and near < len(spans) and spans[near][0] < start + len(core):
            label = spans[near][1] + 1 if start < spans[near][2] else None
            near += 1
        before = matches[place - 1].group() if place else ""
        behind = matches[place + 1].group() if place + 1 < len(matches) else ""
        features = (
            _hashed("shape", shape(core)),
            _hashed("before", shape(before) if _DIGIT_OR_AT.search(before) else before.lower()[:24]),
            _hashed("behind", shape(behind) if _DIGIT_OR_AT.search(behind) else ""),
        )
        found.append(Token(start, start + len(core), label, features, form(core)))
    return found


def edges_of(text: str, tokens: list[Token], hubs: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens with nothing but spaces and marks between them, and skip edges between tokens of the
    same form, unless a chain edge links the two: from each to the next, or, with ``hubs``, between one of them and
    each other one. That one is the first fixed by an expression, else the first. Both keep their number linear; with
    hubs any two tokens of a form are at most two edges apart."""
    chain = [
        (n, n + 1)
        for n, (one, two) in enumerate(zip(tokens, tokens[1:]))
        if two.start - one.end <= 8 and not any(letter.isalnum() for letter in text[one.end : two.start])
    ]
    skip, near = [], set(chain)
    if hubs:
        hub: dict[str, int] = {}
        for n, token in enumerate(tokens):
            if token.form not in hub or (token.label is not None and tokens[hub[token.form]].label is None):
                hub[token.form] = n
        pairs = [(min(n, hub[token.form]), max(n, hub[token.form])) for n, token in enumerate(tokens)]
        return chain, [pair for pair in pairs if pair[0] < pair[1] and pair not in near]
    last: dict[str, int] = {}
    for n, token in enumerate(tokens):
        if token.form in last and (last[token.form], n) not in near:
            skip.append((last[token.form], n))
        last[token.form] = n
    return chain, skip


@dataclass(frozen=True)
class Field:
    """Log weights: ``node[feature, label]``, ``prior[label]``, ``chain[label, label]``; ``skip`` for equal labels."""

    node: np.ndarray
    prior: np.ndarray
    chain: np.ndarray
    skip: float

    def marginals(self, text: str, tokens: list[Token], rounds: int = ROUNDS) -> tuple[np.ndarray, bool]:
        """Label probabilities of the tokens by loopy message passing with damping, and whether it converged."""
        count = len(LABELS)
        node = np.array([self.prior + sum(self.node[feature] for feature in token.features) for token in tokens])
        for place, token in enumerate(tokens):
            if token.label is not None:
                node[place] = -50.0
                node[place, token.label] = 0.0
        chain, skip = edges_of(text, tokens, hubs=True)
        if not chain and not skip:
            return _normal(node), True
        edges = np.array(chain + skip)
        agree = np.where(np.eye(count, dtype=bool), self.skip, 0.0)
        factor = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(agree[None], len(skip), 0)])
        factor = np.exp(factor)
        # Both directions: from source to target.
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), count))
        converged = False
        for _ in range(rounds):
            belief = node.copy()
            np.add.at(belief, target, message)
            leaving = _normal(belief[source] - message[back])
            fresh = np.log(np.einsum("es,est->et", leaving, factor) + 1e-300)
            fresh -= fresh.max(axis=1, keepdims=True)
            change = np.abs(fresh - message).max()
            message = 0.5 * message + 0.5 * fresh
            converged = bool(change < 1e-4)
            if converged:
                break
        belief = node.copy()
        np.add.at(belief, target, message)
        return _normal(belief), converged


def _normal(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return weights / weights.sum(axis=-1, keepdims=True)


COUNTS = "what string, first int, second int, times long"


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: features by label, neighbouring labels, and how often tokens of one form have one label."""
    node = np.zeros((FEATURES, len(LABELS)), np.int64)
    chain = np.zeros((len(LABELS), len(LABELS)), np.int64)
    skip = np.zeros((len(LABELS), len(LABELS)), np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text or not _DIGIT_OR_AT.search(text):
                continue
            tokens = tokens_of(text, base_spans(text))
            labels = [token.label or 0 for token in tokens]
            for token, label in zip(tokens, labels):
                for feature in token.features:
                    node[feature, label] += 1
            near, far = edges_of(text, tokens)
            for table, edges in ((chain, near), (skip, far)):
                for one, two in edges:
                    table[labels[one], labels[two]] += 1
    rows = [
        (what, int(one), int(two), int(table[one, two]))
        for what, table in (("node", node), ("chain", chain), ("skip", skip))
        for one, two in zip(*np.nonzero(table))
    ]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)], ["what", "first", "second", "times"]
    )


def train(docs: DataFrame) -> Field:
    """A field fitted to all documents, with the expressions' matches as labels.

    Only counts reach the driver: at most FEATURES * 5 + 50 rows, whatever the corpus.
    """
    Scratch(docs.sparkSession, "pii")
    counted = (
        docs.select("text").mapInArrow(_counting, COUNTS).groupBy("what", "first", "second").agg(F.sum("times").alias("times"))
    )
    tables = {
        "node": np.zeros((FEATURES, len(LABELS))),
        "chain": np.zeros((len(LABELS), len(LABELS))),
        "skip": np.zeros((len(LABELS), len(LABELS))),
    }
    for row in counted.collect():
        tables[row["what"]][row["first"], row["second"]] = row["times"]
    node, chain, skip = tables["node"], tables["chain"], tables["skip"]
    total = node.sum(axis=0) / 3 + 1.0
    prior = np.log(total / total.sum())
    seen = node.sum(axis=1, keepdims=True)
    share = total / total.sum()
    # How much a feature raises or lowers each label; two tokens like the average are added to each feature.
    weights = np.log((node + 2.0 * share) / (seen + 2.0)) - np.log(share)
    pairs = (chain + 1.0) / (chain + 1.0).sum()
    transition = np.log(pairs) - np.log(pairs.sum(axis=1, keepdims=True)) - np.log(pairs.sum(axis=0, keepdims=True))
    same = (np.trace(skip) + 2.0) / (skip.sum() + 4.0)
    return Field(weights, prior, np.clip(transition, -4.0, 4.0), float(np.clip(np.log(same / (1.0 - same)), 0.5, 6.0)))


def refuted(kind: int, mention: str) -> bool:
    """Whether a mention is a whole number of its kind that fails the kind's test. A part of one, such as its last digits,
    has no test."""
    digits = "".join(letter for letter in mention if "0" <= letter <= "9")
    if KINDS[kind] == "card":
        return len(digits) > 19 or (len(digits) >= 12 and not luhn(digits))
    if KINDS[kind] == "phone":
        return len(digits) > 15
    if KINDS[kind] == "ip":
        return any(int(part) > 255 for part in re.findall("[0-9]{1,18}", mention))
    return False


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, least: float) -> tuple[list[tuple[int, int, int]], bool]:
    """Runs of neighbouring tokens outside the base spans that the field gives one kind and that do not fail the kind's
    own test, and whether it converged."""
    tokens = tokens_of(text, base)
    if not any(token.label is None for token in tokens):
        return [], True
    chances, converged = field.marginals(text, tokens)
    found: list[list[int]] = []
    last = -2
    chain = {two for _, two in edges_of(text, tokens)[0]}
    for place, token in enumerate(tokens):
        label = int(chances[place].argmax())
        if token.label is not None or label == 0 or chances[place, label] < least:
            continue
        if found and last == place - 1 and place in chain and found[-1][1] == label - 1:
            found[-1][2] = token.end
        else:
            found.append([token.start, label - 1, token.end])
        last = place
    return [tuple(span) for span in found if not refuted(span[1], text[span[0] : span[2]])], converged


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCANNED = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, "
    "converged boolean"
)


def _scanning(shared, least: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for batch in batches_of(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text) if text else []
                    added, converged = added_spans(text, base, field, least) if text else ([], True)
                    count = [sum(kind == n for _, kind, _ in base) for n in range(len(KINDS))]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    rows.append((*count, digest, _joined(sorted(base + added)), len(added), converged))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")] + [pa.array([row[n] for row in rows], kind) for n, kind in enumerate(kinds)],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "converged"],
                )

    return task


def scan(docs: DataFrame, field: Field | None = None, least: float = 0.7) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the number of base spans of each kind, ``base_sha256`` (digest of the base
    spans), ``spans`` (base and added ones as kind:start:end, by start and kind), ``n_added``, and ``converged``: false
    where message passing was ended before it converged, so that such documents can be counted.

    No shuffle: a document is judged where it is read. Cases: a null or empty text has no spans; a document without
    digit or at sign has no field; a token repeated any number of times has linearly many edges; rows that repeat are
    judged each; a null id is returned; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    field = field or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanning(spark.sparkContext.broadcast(field), least), SCANNED)

