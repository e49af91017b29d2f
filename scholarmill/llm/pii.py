"""Personal data by a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.llm import kernels as K

KINDS = ("email", "ip", "phone", "card", "ssn")
LABELS = ("O",) + tuple(f"{x}-{k}" for k in KINDS for x in "BI")
#: Rows of the labelled table that a model is fitted on at most, and its fitting: steps, rate, L2 penalty.
TRAIN_ROWS, STEPS, RATE, PENALTY = 600, 90, 0.25, 0.01
#: Tokens that one Viterbi batch holds at most, with what pads it.
BATCH = 200_000
IMPOSSIBLE = -1e6

_HOT = np.array([chr(b).isdigit() and b < 128 or chr(b) in "@+" for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_NOISE = "\"'<>[]{}#$%&*!?;,.:…»«“”„"


def hot(token: str) -> bool:
    """Whether a token may be a part of personal data: it has a digit, an @ or a +."""
    return any(c in "0123456789@+" for c in token)


@lru_cache(200_000)
def shape_features(token: str) -> tuple[str, ...]:
    """Of a word's shape alone: runs of digits and of letters, with and without lengths, and what stands at its ends."""
    core = token.strip(_NOISE) or token
    if core[-1:] == ")" and "(" not in core:
        core = core[:-1].rstrip(_NOISE) or core
    elif core[:1] == "(" and ")" not in core and "@" in core:
        core = core[1:]
    runs = _RUNS.findall(core)
    form = "".join("d" if x[0].isdigit() else "x" if x[0].isalpha() else x for x in runs)
    sized = "".join(str(min(len(x), 20)) if x[0].isdigit() else "x" if x[0].isalpha() else x for x in runs)
    digits = sum(len(x) for x in runs if x[0].isdigit())
    out = [f"form={form[:24]}", f"sized={sized[:32]}", f"digits={min(digits, 20)}", f"letters={'x' in form}", f"first={form[:2]}", f"last={form[-2:]}", f"long={min(len(core) // 4, 8)}"]
    if "@" in form:
        head, _, tail = form.partition("@")
        out.append(f"at={bool(head)}{'.' in tail}{form.count('@') == 1}{head[-1:] in ('x', 'd')}{tail[-1:]}")
    numbers = core.split(".")
    if len(numbers) > 1 and all(x.isdigit() for x in numbers):
        out.append(f"dotted={len(numbers)}{all(len(x) < 4 and int(x) < 256 for x in numbers)}")
    if core.count(":") > 1 and re.fullmatch(r"[0-9a-fA-F:]+", core):
        out.append(f"colons={min(core.count(':'), 3)}")
    return tuple(out)


def features(tokens: list[str]) -> list[tuple[str, ...]]:
    """Of each token, by its shape and by those of the hot tokens beside it."""
    own = [shape_features(x) if hot(x) else () for x in tokens]
    out = []
    for i, f in enumerate(own):
        before = own[i - 1][1] if i and own[i - 1] else "plain"
        after = own[i + 1][1] if i + 1 < len(own) and own[i + 1] else "plain"
        out.append(f + (f"before:{before}", f"after:{after}", f"{f[1]}|{after}", f"{before}|{f[1]}") if f else f)
    return out


class Field:
    """Weights of features and transitions. A token that isn't hot is O by constraint, and an I follows only its own kind."""

    def __init__(self):
        k = len(LABELS)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, k))
        self.allowed = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
        self.transitions = np.zeros((k, k))

    def _padded(self, sequences: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores [n, longest, labels], length): what lies beyond a sequence's end is O."""
        length = np.array([len(x) for x in sequences])
        scores = np.zeros((len(sequences), int(length.max(initial=0)), len(LABELS)))
        scores[:, :, 1:] = IMPOSSIBLE
        at, where, feature = [], [], []
        for i, x in enumerate(sequences):
            for j, f in enumerate(x):
                if f:
                    scores[i, j] = 0
                    for name in f:
                        n = self.index.get(name)
                        if n is not None:
                            at.append(i)
                            where.append(j)
                            feature.append(n)
        self._where = np.array(at, np.int64), np.array(where, np.int64), np.array(feature, np.int64)
        if at:
            np.add.at(scores, self._where[:2], self.weights[self._where[2]])
        return scores, length

    def fit(self, sequences: list[list[str]], labels: list[list[str]]) -> "Field":
        """Maximise the penalised likelihood of labelled token sequences by gradient steps with Adam; all from zero, no chance."""
        sequences, labels = sequences[:TRAIN_ROWS], labels[:TRAIN_ROWS]
        feats = [features(x) for x in sequences]
        names = sorted({n for x in feats for f in x for n in f})
        self.index = {n: i for i, n in enumerate(names)}
        k = len(LABELS)
        self.weights = np.zeros((len(names), k))
        mask = np.where(self.allowed, 0, IMPOSSIBLE)
        _, length = self._padded(feats)
        at, where, feature = self._where
        n, longest = len(feats), int(length.max())
        known = {x: i for i, x in enumerate(LABELS)}
        gold = np.zeros((n, longest), np.int64)
        for i, x in enumerate(labels):
            gold[i, : len(x)] = [known[y] for y in x]
        base = np.zeros((n, longest, k))
        base[:, :, 1:] = IMPOSSIBLE
        base[at, where] = 0
        moments = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros((k, k)), np.zeros((k, k))]
        seen = np.zeros_like(self.weights)
        np.add.at(seen, (feature, gold[at, where]), 1)
        moved = np.zeros((k, k))
        np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        for step in range(1, STEPS + 1):
            score = base.copy()
            np.add.at(score, (at, where), self.weights[feature])
            trans = self.transitions + mask
            forward = np.empty_like(score)
            backward = np.zeros_like(score)
            forward[:, 0] = score[:, 0] + mask[0]
            for t in range(1, longest):
                x = forward[:, t - 1, :, None] + trans
                top = x.max(1)
                forward[:, t] = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t]
            for t in range(longest - 2, -1, -1):
                x = trans + (score[:, t + 1] + backward[:, t + 1])[:, None]
                top = x.max(2)
                backward[:, t] = top + np.log(np.exp(x - top[:, :, None]).sum(2))
            top = forward[:, -1].max(1)
            total = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(1))
            single = np.exp(forward + backward - total[:, None, None])
            pairs = np.zeros((k, k))
            for t in range(1, longest):
                pairs += np.exp(forward[:, t - 1, :, None] + trans + (score[:, t] + backward[:, t])[:, None] - total[:, None, None]).sum(0)
            want = np.zeros_like(self.weights)
            np.add.at(want, feature, single[at, where])
            rate = RATE * (1 - step / (STEPS + 1))
            for grad, param, a, b in ((seen - want - PENALTY * self.weights, self.weights, moments[0], moments[1]), (np.where(self.allowed, moved - pairs - PENALTY * self.transitions, 0), self.transitions, moments[2], moments[3])):
                a[...] = 0.9 * a + 0.1 * grad
                b[...] = 0.98 * b + 0.02 * grad**2
                param += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
        return self

    def decode(self, runs: list[list[str]]) -> list[list[int]]:
        """The best labels of each run of hot tokens, which O surrounds; batches of runs of like length."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        trans = self.transitions + np.where(self.allowed, 0, IMPOSSIBLE)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(runs[order[end]]) <= BATCH:
                end += 1
            mine = order[at:end]
            score, length = self._padded([features(runs[i]) for i in mine])
            n, longest, k = score.shape
            back = np.zeros((n, longest, k), np.int8)
            best = score[:, 0] + trans[0]
            for t in range(1, longest):
                x = best[:, :, None] + trans
                back[:, t] = x.argmax(1)
                best = x.max(1) + score[:, t]
            best = best + trans[:, 0]
            label = best.argmax(1)
            path = np.zeros((n, longest), np.int64)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(n), t, label]
            for i, row, m in zip(mine, path.tolist(), length.tolist()):
                out[i] = row[:m]
            at = end
        return out


def labelled_rows(n: int = TRAIN_ROWS, seed: int = 1) -> list[tuple[list[str], list[str]]]:
    """Made sentences, (tokens, labels): personal data and what looks like it, among plain words with and without noise."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n, low="0": "".join(str(x) for x in rng.integers(0, 10, n)) if low == "0" else str(rng.integers(1, 10)) + digits(n - 1) if n > 1 else str(rng.integers(1, 10))
    word = lambda lo=2, hi=9: "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(lo, hi))))
    octet = lambda: str(rng.integers(0, 256))

    def email() -> list[str]:
        user = pick(word() + pick(".", "_", "-", "") + word(1, 6), word() + "." + digits(2), word() + digits(int(rng.integers(1, 5))), word(), word() + "+" + word())
        host = pick(word(), f"mail{digits(1)}.{word()}", f"{word()}-{word()}", f"{word()}.{word()}", f"{word()}{digits(1)}") + "." + pick("com", "org", "de", "fr", "co.uk", "es", "net", "io")
        return [pick(str, str, str.upper, str.title)(f"{user}@{host}")]

    def ip() -> list[str]:
        if rng.random() < 0.12:
            return [pick(f"{digits(4)}:db8:{word(1, 3)}{digits(1)}::{digits(1)}".replace("g", "a"), "fe80::" + ":".join(f"{x:x}" for x in rng.integers(0, 65536, 4)), ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8)))]
        return [".".join(octet() for _ in range(4))]

    def phone() -> list[str]:
        return pick(
            [f"+{digits(1, '1')}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(1, '1')}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"],
            [f"+{digits(2, '1')}", digits(2), digits(4), digits(4)], [f"+{digits(2, '1')}", digits(1, "1"), digits(2), digits(2), digits(2), digits(2)], [f"+{digits(11, '1')}"], [f"+{digits(12, '1')}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"({digits(3)}){digits(3)}-{digits(4)}"], [f"+{digits(2, '1')}", digits(3), digits(7)],
        )

    def card() -> list[str]:
        return pick([digits(16, "1")], [digits(16, "1")], [digits(16, "1")], [digits(4, "1"), digits(4), digits(4), digits(4)], ["-".join([digits(4, "1"), digits(4), digits(4), digits(4)])], [digits(4, "1"), digits(6), digits(5)], [digits(15, "1")])

    def ssn() -> list[str]:
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"]

    def other() -> list[str]:
        hexes = "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, int(pick(32, 40, 64))))
        return pick(
            [str(rng.integers(1900, 2030))], [digits(int(rng.integers(1, 13)), "1")], [f"{digits(1)}.{digits(2)}"], [f"{digits(2, '1')}.{digits(1)}%"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [f"v{digits(1)}.{digits(2)}.{digits(1)}"], [f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"], [f"{digits(2)}/{digits(2)}/{rng.integers(1990, 2030)}"],
            [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}:{digits(2)}:{digits(2)}"], [f"${digits(1, '1')},{digits(3)}.{digits(2)}"], [f"{digits(3, '1')},{digits(3)}"], [pick("1st", "2nd", "3rd", "4th", "x86", "A4", "B2B", "c++", "+", "CO2")], [hexes], ['"' + hexes + '"'], [f"@{word()}"], [f"{digits(1)}+{digits(1)}"], [f"{digits(2)}-{digits(2)}"], [f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"],
            ["CC", "BY-NC", f"{digits(1)}.{digits(1)}"], [f"http://{word()}.{word()}.com/{word()}/{digits(3)}?page={digits(1)}&ref=x"], [digits(int(rng.integers(17, 30)), "1")], [f"#{digits(5)}"], [f"{word()}{digits(2)}"], [f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}"], ["@"], [f"{rng.integers(256, 1000)}.{rng.integers(256, 1000)}.{rng.integers(256, 1000)}.{rng.integers(256, 1000)}"], [digits(int(rng.integers(1, 4)), "1"), digits(int(rng.integers(1, 4)), "1")],
            [f"{digits(2, '1')}.{digits(3)}.{digits(3)}"], [f"{digits(4)}-{digits(4)}"], [f"({rng.integers(1990, 2030)})"], [f"({digits(1)})"], [f"[{digits(2)}]"], [f"{word()}_{digits(3)}.{word(2, 4)}"], [f"{rng.integers(1990, 2030)}", f"{digits(2)}"],
            [digits(int(rng.integers(1, 5)), "1") for _ in range(int(rng.integers(3, 13)))], [digits(int(rng.integers(1, 3)), "1") for _ in range(int(rng.integers(3, 13)))], [digits(1, "1")] * int(rng.integers(3, 13)), [f"{digits(1)}.{digits(2)}" for _ in range(int(rng.integers(3, 9)))],
        )

    make = {"email": email, "ip": ip, "phone": phone, "card": card, "ssn": ssn}
    out = []
    for _ in range(n):
        noise = rng.random() < 0.3
        end = lambda: pick("", "", "", ".", ",", ";", "!!", "###", "&&&", "%%%", "$$$", "***") if noise else pick("", "", "", "", ".", ",", ")", "!")
        tokens, labels = [word()], ["O"]
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.62:
                kind = KINDS[int(rng.integers(len(KINDS)))]
                mine = make[kind]()
                tag = [f"B-{kind}"] + [f"I-{kind}"] * (len(mine) - 1)
                if rng.random() < 0.12 and len(mine) == 1:
                    mine, tag = mine * 2, tag * 2
            else:
                mine = other()
                tag = ["O"] * len(mine)
            mine[-1] += end()
            plain = int(rng.choice([0, 1, 2, 3], p=[0.12, 0.4, 0.3, 0.18]))
            if rng.random() < 0.06:
                mine[0] = "(" + mine[0]
            tokens += mine + [word() + end() for _ in range(plain)]
            labels += tag + ["O"] * plain
        out.append((tokens, labels))
    return out


def labelled_table(spark: SparkSession, n: int = TRAIN_ROWS, seed: int = 1) -> DataFrame:
    """labelled_rows() as a table (row_id, tokens, labels)."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(labelled_rows(n, seed))], "row_id long, tokens array<string>, labels array<string>")


def train(labelled: DataFrame) -> Field:
    """A field fitted on the first TRAIN_ROWS rows of a labelled table, by row_id."""
    rows = labelled.orderBy("row_id").limit(TRAIN_ROWS).select("tokens", "labels").collect()
    return Field().fit([list(r[0]) for r in rows], [list(r[1]) for r in rows])


_FIELDS: list[Field] = []


def default_field(spark: SparkSession) -> Field:
    """The field fitted on labelled_table(), once in a driver."""
    if not _FIELDS:
        _FIELDS.append(train(labelled_table(spark)))
    return _FIELDS[0]


def _hot_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, first of a run) of each hot token; a run has hot tokens of one row with nothing but white space between."""
    where = np.flatnonzero(_HOT[data])
    space = np.flatnonzero(_SPACE[data])
    row = np.searchsorted(offsets, where, "right") - 1
    next_space = np.searchsorted(space, where)
    padded = np.concatenate([[-1], space, [len(data)]])
    start = np.maximum(padded[next_space] + 1, offsets[row])
    end = np.minimum(padded[next_space + 1], offsets[row + 1])
    start, first = np.unique(start, return_index=True)
    row, end = row[first], end[first]
    new = np.ones(len(start), bool)
    between = np.searchsorted(space, start[1:]) - np.searchsorted(space, end[:-1])
    new[1:] = (row[1:] != row[:-1]) | (between != start[1:] - end[:-1])
    return row, start, end, new


def _trim(value: str, kind: str) -> tuple[int, int]:
    a = len(value) - len(value.lstrip(_NOISE))
    b = len(value.rstrip(_NOISE))
    if value[b - 1 : b] == ")" and value[a:b].count("(") < value[a:b].count(")"):
        b = a + len(value[a : b - 1].rstrip(_NOISE))
    if value[a : a + 1] == "(" and ")" not in value[a:b]:
        a += 1
    if kind != "phone" and value[a : a + 1] == "(" and value[b - 1 : b] == ")":
        a, b = a + 1, b - 1
    return a, b


def find(column: pa.Array, field: Field) -> list[tuple[int, int, int, str, str]]:
    """(row, start, end, kind, value) of a text column, positions in characters."""
    data, offsets = K.utf8(column)
    if not len(data):
        return []
    row, start, end, new = _hot_runs(data, offsets)
    raw = data.tobytes()
    tokens = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
    heads = np.append(np.flatnonzero(new), len(tokens)).tolist()
    runs = [tokens[a:b] for a, b in zip(heads, heads[1:])]
    spans = []
    for head, labels in zip(heads, field.decode(runs)):
        t = 0
        while t < len(labels):
            name = LABELS[labels[t]]
            u = t + 1
            if name[0] == "B":
                while u < len(labels) and LABELS[labels[u]] == "I" + name[1:]:
                    u += 1
                spans.append((int(row[head + t]), int(start[head + t]), int(end[head + u - 1]), name[2:]))
            t = u
    if not spans:
        return []
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for r, a, b, kind in spans:
        value = raw[a:b].decode()
        lo, hi = _trim(value, kind)
        begin = int(letters[a] - letters[offsets[r]])
        if hi > lo:
            out.append((r, begin + lo, begin + hi, kind, value[lo:hi]))
    return out


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(key, start, end, kind, value) of each piece of personal data in each row, positions in characters.

    kind is email, ip, phone, card or ssn. Tokens stand between white space.
    Only tokens with a digit, an @ or a + can be labelled, by constraint of
    the model, so its best path over a whole text is made of those over the
    runs of such tokens; no others are scored. Without a field, one is fitted
    on labelled_table(), once in a driver. Null and empty texts have none; repeated rows give
    repeated results, a null key a null. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field(docs.sparkSession))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = d.select("key").schema.add("start", "long").add("end", "long").add("kind", "string").add("value", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 1024):
                found += [(r + at, *x) for r, *x in find(batch.column(1).slice(at, 1024), shared.value)]
            rows, *rest = list(zip(*found)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(rest, kinds)], ["key", "start", "end", "kind", "value"])

    return d.mapInArrow(run, schema).withColumnRenamed("key", key)
