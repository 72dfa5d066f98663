"""Personal data in whole texts: patterns, and a skip-chain conditional random field (operator 10).

The patterns give the base spans.  The field adds spans of tokens that look and stand like
personal data but fail the patterns, and of secrets.  Its nodes are the tokens with a digit or an
at sign and their neighbours; chain edges join neighbouring tokens, and skip edges join distant
tokens that are repeated or similar, so that loopy message passing makes their labels agree across
the document.  Tokens of base spans keep their labels.

The field is trained by pseudo-likelihood on a bounded sample of documents (``TRAIN_DOCS``, and
``TRAIN_NODES`` tokens of each): as they are, and as copies in which base spans are written in
ways that the patterns miss, mentioned again elsewhere, and mixed with other numbers.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import map_arrow, pieces, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of which only the field knows spans.
MORE_KINDS = ("secret",)
ALL_KINDS = KINDS + MORE_KINDS
#: The labels of a token: 0 is none, i + 1 is ALL_KINDS[i].
LABELS = len(ALL_KINDS) + 1
TRAIN_DOCS, TRAIN_NODES = 2_000, 256
BATCH_BYTES = 1 << 21
#: A token becomes a span if its marginal for a kind is at least this.
CONFIDENCE = 0.9
FEATURES = 1 << 12
ROUNDS, DAMPING = 20, 0.5

#: The base patterns; that of emails is looked for around each at sign.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the value of a secret stands behind, for training.
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_+/.=-]{16,200})(?![A-Za-z0-9_+/.=-])""", re.I)

_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@\uff20]|[(\[]at[)\]]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A local part ends at its at sign, so it is read backwards from there: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield 0, start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start; leftmost and non-overlapping within a kind.

    A match that fails its test is dropped, and the search goes on after it.  An address begins
    where its digits begin, as a search from within them would find nothing else; so no run of
    digits or letters is read more than a few times.
    """
    out: list[Span] = list(_emails(text))
    for m in _IP.finditer(text):
        # a part of more digits than 3 may still be small: leading zeros
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """A document's tokens of interest: places, edges, features, labels of known tokens."""

    spans: list[tuple[int, int]]
    candidate: np.ndarray  # bool
    chain: np.ndarray  # (edges, 2)
    skip: np.ndarray  # (edges, 2)
    features: np.ndarray  # (nodes, names)
    label: np.ndarray  # of tokens in the given spans; 0 for others


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "big") % FEATURES


def _shape(token: str) -> str:
    """Digits as 9, letters as a, repeats as one."""
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token[:64]))
    return re.sub(r"(.)\1+", r"\1+", shape)[:24]


def _alike(token: str) -> list[str]:
    """What tokens share that are repeated or similar.

    Numbers share their digits, long ones also either half of them, so that one wrong digit does
    not part them; other tokens share their letters and digits.
    """
    digits = re.sub(r"[^0-9]", "", token[:64])
    if len(digits) < 6:
        letters = re.sub(r"[(\[](at|dot)[)\]]|[^0-9a-z]", "", token[:128].lower())
        return [letters] if len(letters) >= 4 else []
    half = len(digits) // 2
    return [digits, "<" + digits[:half], ">" + digits[half:]] if len(digits) >= 12 else [digits]


def _names(words: list[str], i: int) -> list[str]:
    w = words[i]
    before, after, second = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "", words[i - 2] if i > 1 else ""
    core = w.strip(".,;:!?\"'()[]{}<>")[:256]
    digits, letters = sum(c in "0123456789" for c in core), sum(c.isalpha() for c in core)
    parts = re.split(r"[^0-9a-zA-Z]+", core[:64])
    size = max(1, len(core))
    mixed = bool(re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}", core))
    return [
        "bias", f"shape {_shape(w)}", f"digits {min(digits, 20)}", f"dots {min(core.count('.'), 5)}", f"at {'@' in w or chr(0xFF20) in w} {'(at)' in w or '[at]' in w}",
        f"plus {w[0] == '+'} {w[0] == '('}", f"share {10 * digits // size} {10 * letters // size}", f"size {min(len(core) // 4, 12)}", f"mixed {mixed}", f"parts {','.join(str(min(len(p), 9)) for p in parts[:6])}",
        f"numbers {sum(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)} {len(parts)}", f"mark {re.sub('[0-9a-zA-Z]', '', core)[:6]}",
        f"before {_shape(before)}", f"after {_shape(after)}", f"word before {before.lower()[:16]}", f"second {second.lower()[:16]}",
    ]


def graph(text: str, spans: list[Span], most: int | None = None) -> Graph:
    """The graph of a text, or of the first ``most`` of its tokens; linear in the text."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    hints = [i for i, w in enumerate(words) if _HINT.search(w)]
    chosen = sorted({j for i in hints for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})[:most]
    node = {i: k for k, i in enumerate(chosen)}
    marks = set(hints)
    label, starts = np.zeros(len(chosen), np.int64), [tokens[i][0] for i in chosen]
    ends = np.array([tokens[i][1] for i in chosen], np.int64)
    for kind, start, end in spans:
        first = int(np.searchsorted(ends, start, "right"))
        while first < len(chosen) and starts[first] < end:
            label[first] = kind + 1
            first += 1
    names = [[_bucket(n) for n in _names(words, i)] for i in chosen]
    chain = {(node[i], node[i + 1]) for i in chosen if i + 1 in node}
    # an edge from each token to the last one like it keeps the edges linear in the tokens
    last: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for k, i in enumerate(chosen):
        if i in marks:
            for key in _alike(words[i]):
                if key in last and (last[key], k) not in chain:
                    skip.add((last[key], k))
                last[key] = k

    def edges(found: set[tuple[int, int]]) -> np.ndarray:
        return np.array(sorted(found), np.int64).reshape(-1, 2)

    return Graph([tokens[i] for i in chosen], np.array([i in marks for i in chosen], bool), edges(chain), edges(skip), np.array(names, np.int64).reshape(len(chosen), -1), label)


@dataclass
class Field:
    """Weights of the nodes (features, labels), of chain edges and of skip edges (labels, labels)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy belief propagation with damped messages; (nodes, labels).

        Labels of base spans are given; so is none for a neighbour that is no candidate.
        """
        if not len(g.spans):
            return np.zeros((0, LABELS))
        local = self.node[g.features].sum(axis=1)
        given = np.flatnonzero((g.label > 0) | ~g.candidate)
        local[given] = -30.0
        local[given, g.label[given]] = 0.0
        # (tails, heads, weights) of messages in one direction; the next entry has their opposites
        sides = [(e[:, x], e[:, 1 - x], np.exp(w if x == 0 else w.T)) for e, w in ((g.chain, self.chain), (g.skip, self.skip)) if len(e) for x in (0, 1)]
        messages = [np.zeros((len(tail), LABELS)) for tail, _, _ in sides]
        for _ in range(ROUNDS if sides else 0):
            belief = local.copy()
            for (_, head, _), message in zip(sides, messages, strict=True):
                np.add.at(belief, head, message)
            moved = 0.0
            new = []
            for k, (tail, _, weight) in enumerate(sides):
                x = belief[tail] - messages[k ^ 1]
                out = np.log(np.exp(x - x.max(axis=1, keepdims=True)) @ weight + 1e-30)
                out -= out.max(axis=1, keepdims=True)
                moved = max(moved, float(np.abs(out - messages[k]).max()))
                new.append(DAMPING * messages[k] + (1 - DAMPING) * out)
            messages = new
            if moved < 1e-3:
                break
        for (_, head, _), message in zip(sides, messages, strict=True):
            np.add.at(local, head, message)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(graphs: list[Graph], epochs: int = 120, rate: float = 0.3, penalty: float = 2e-5) -> Field:
    """All weights by pseudo-likelihood: each candidate's label given its features and its neighbours' labels."""
    graphs = [g for g in graphs if len(g.label)]
    node, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not graphs:
        return Field(node, chain, skip)
    begin = np.cumsum([0, *(len(g.label) for g in graphs)])
    y = np.concatenate([g.label for g in graphs])
    free = np.flatnonzero(np.concatenate([g.candidate for g in graphs]))
    x = np.concatenate([g.features for g in graphs])[free]
    target = np.eye(LABELS)[y[free]]

    def neighbours(name: str, side: int) -> np.ndarray:
        """How many neighbours of each label a candidate has on one side of its edges; they don't change."""
        edges = np.concatenate([getattr(g, name) + b for g, b in zip(graphs, begin, strict=False)])
        counts = np.bincount(edges[:, 1 - side] * LABELS + y[edges[:, side]], minlength=len(y) * LABELS)
        return counts.reshape(len(y), LABELS)[free].astype(np.float64)

    before, after = neighbours("chain", 0), neighbours("chain", 1)
    like = neighbours("skip", 0) + neighbours("skip", 1)
    flat, seen = x.ravel(), [np.full_like(w, 1e-8) for w in (node, chain, skip)]
    for _ in range(epochs):
        z = node[x].sum(axis=1) + before @ chain + after @ chain.T + like @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) / len(y)
        of_nodes = np.stack([np.bincount(flat, np.repeat(error[:, k], x.shape[1]), FEATURES) for k in range(LABELS)], axis=1)
        of_skip = like.T @ error
        gradients = [of_nodes, before.T @ error + error.T @ after, of_skip + of_skip.T]  # a skip edge has no direction
        for w, gradient, s in zip((node, chain, skip), gradients, seen, strict=True):
            gradient += penalty * w
            s += gradient**2
            w -= rate * gradient / np.sqrt(s)
    return Field(node, chain, skip)


def added_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """Spans of tokens that the field labels, none of which overlaps a base span.

    Neighbouring tokens of one kind are one span, without the punctuation around it; secrets are
    spans of their own.
    """
    g = graph(text, base)
    if not (g.candidate & (g.label == 0)).any():
        return []
    p = model.marginals(g)
    runs: list[list[int]] = []
    for k in np.flatnonzero(g.candidate & (g.label == 0) & (p.argmax(axis=1) > 0) & (p.max(axis=1) >= CONFIDENCE)):
        kind, (start, end) = int(p[k].argmax()) - 1, g.spans[k]
        if runs and runs[-1][0] == kind < len(KINDS) and text[runs[-1][2] : start].isspace():
            runs[-1][2] = end
        else:
            runs.append([kind, start, end])
    out = []
    for kind, start, end in runs:
        found = text[start:end]
        start += len(found) - len(found.lstrip(".,;:!?\"'([{<" if kind != 3 else ".,;:!?\"'[{<"))
        end -= len(found) - len(found.rstrip(".,;:!?\"')]}>%$#&*|"))
        if end > start:
            out.append((kind, start, end))
    return out


def _variant(kind: int, found: str, rng: random.Random) -> str:
    """The same data, written in a way that its pattern misses."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 0:
        user, host = found.split("@")
        return rng.choice([f"{user}(at){host}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user}\uff20{host}", f"{user}@{host.replace('.', '(dot)')}"])
    if kind == 1:
        return rng.choice([found.replace(".", x) for x in ("[.]", "-", ",", "(.)", "_")])
    if kind == 2:
        wrong = rng.randrange(len(digits))
        changed = digits[:wrong] + str((int(digits[wrong]) + rng.randrange(1, 10)) % 10) + digits[wrong + 1 :]
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([changed, *(x.join(groups) for x in "._/:")])
    if kind == 3:
        return rng.choice([digits, found.lstrip("+"), found.replace(" ", "/"), re.sub(r"[^+0-9]+", "/", found), f"{digits[:-10]}({digits[-10:-7]}){digits[-7:-4]}-{digits[-4:]}"])
    return found


def _other(rng: random.Random) -> str:
    """A number that is no personal data."""
    digits = "".join(rng.choice("0123456789") for _ in range(20))
    card = digits[: rng.randrange(13, 20)]
    if luhn(card):
        card = card[:-1] + str((int(card[-1]) + 1) % 10)
    return rng.choice([card, card, digits[: rng.randrange(1, 12)], digits[: rng.randrange(9, 12)], f"{digits[0]}.{digits[1]}", f"v{digits[0]}.{digits[1]}.{digits[2]}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:2]}:{digits[2:4]}", f"{digits[:3]},{digits[3:6]}.{digits[6:8]}", f"{digits[:2]}%"])


def noisy(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """A copy of the text and its spans: some written otherwise, some mentioned again, other numbers put in."""
    out: list[str] = []
    found: list[Span] = []
    at = size = 0
    again: list[tuple[int, str]] = []

    def put(part: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            found.append((kind, size, size + len(part)))
        out.append(part)
        size += len(part)

    def between(part: str) -> None:
        """Words, after some of which a number or a second mention is put in."""
        last = 0
        for m in re.finditer(r"\s+", part):
            if rng.random() < 0.04:
                put(part[last : m.end()])
                last = m.end()
                if again and rng.random() < 0.6:
                    kind, what = again.pop(rng.randrange(len(again)))
                    put(what, kind)
                else:
                    put(_other(rng))
                put(" ")
        put(part[last:])

    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start < at:
            continue
        between(text[at:start])
        own = text[start:end]
        put(own if rng.random() < 0.5 else _variant(kind, own, rng), kind)
        if rng.random() < 0.6:
            again.append((kind, _variant(kind, own, rng)))
        at = end
    between(text[at:])
    return "".join(out), found


def labelled(text: str) -> list[Span]:
    """The base spans, and the secrets that training knows by what stands before them."""
    more = [(len(KINDS), m.start(1), m.end(1)) for m in _SECRET.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    return [*base_spans(text), *more]


def training_graphs(text: str, seed: int) -> list[Graph]:
    rng = random.Random(seed)
    spans = labelled(text)
    return [graph(text, spans, TRAIN_NODES), *(graph(*noisy(text, spans, rng), TRAIN_NODES) for _ in range(2 if spans else 1))]


def train_on(docs: DataFrame) -> Field:
    """Fits the field to TRAIN_DOCS documents with digits or at signs at most, chosen by a hash.

    Only features and labels of TRAIN_NODES tokens of a document and of its copies come to the
    driver, as bytes.
    """
    hinted = docs.where(docs["text"].rlike("[0-9@]")).select("text", F.xxhash64(F.lit(10), "text").alias("draw"))
    sample = hinted.select("draw").distinct().orderBy("draw").limit(TRAIN_DOCS).agg(F.max("draw")).first()[0]
    if sample is None:
        return train([])
    chosen = hinted.where(F.col("draw") <= sample).groupBy("draw").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                graphs = [g for g in training_graphs(text, draw) if len(g.spans)]
                columns = [[draw] * len(graphs), list(range(len(graphs)))]
                columns += [[getattr(g, n).astype("<i2").tobytes() for g in graphs] for n in ("candidate", "chain", "skip", "features", "label")]
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["draw", "k", "candidate", "chain", "skip", "features", "label"])

    rows = map_arrow(chosen.select("draw", "text"), run, "draw long, k long, candidate binary, chain binary, skip binary, features binary, label binary").collect()
    graphs = []
    for r in sorted(rows, key=lambda r: (r["draw"], r["k"])):
        candidate, chain, skip, features, label = (np.frombuffer(bytes(r[n]), "<i2").astype(np.int64) for n in ("candidate", "chain", "skip", "features", "label"))
        graphs.append(Graph([], candidate.astype(bool), chain.reshape(-1, 2), skip.reshape(-1, 2), features.reshape(len(label), -1), label))
    return train(graphs)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of docs.

    Counts and the digest are of the base spans; spans has those that the field added, too (of kind
    ``secret`` as well), as kind:start:end in code points.  A null or empty text has none.  Repeated rows keep their own
    rows, an empty table gives an empty table, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, listed = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text and _HINT.search(text) else []
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed([*base, *added_spans(text, base, model)]) if text and _HINT.search(text) else "")
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train_on(docs))
