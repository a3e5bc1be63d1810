"""The analysis model: settings, character classes, dictionary entries, connection costs.

A Model is a set of plain numpy arrays, small enough to be sent to every executor once (a dictionary of 3 million entries is about
200 MB; ``Model.size`` tells, and ``operators.relational`` offers the join form for larger ones). It can be built from definition texts or
tables, stored as Parquet and loaded again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

NORMAL, UNKNOWN, BOS, EOS, EON = range(5)
#: Settings that hold where nothing else is set.
MINIMAL_CHARS = "DEFAULT 1 0 0\nSPACE 0 1 0\n0x0020 SPACE\n"
MINIMAL_UNKNOWN = "DEFAULT,0,0,0,*\nSPACE,0,0,0,*\n"
MINIMAL_MATRIX = "1 1\n0 0 0\n"


@dataclass
class EngineConf:
    """Typed settings; ``from_text`` reads key = value lines, in which the first value of a key counts."""

    cost_factor: int = 800
    bos_feature: str = "BOS/EOS"
    unk_feature: str | None = None
    max_grouping_size: int = 24
    theta: float = 0.75
    node_format: str = "%m\\t%H\\n"
    unk_format: str = "%m\\t%H\\n"
    bos_format: str = ""
    eos_format: str = "EOS\\n"
    eon_format: str = ""
    left_space_penalty_factor: str = ""
    eval_size: int = 8
    unk_eval_size: int = 4
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_map(cls, values: dict[str, str]) -> EngineConf:
        conf = cls()
        for key, value in values.items():
            name = key.replace("-", "_")
            if name != "extra" and hasattr(conf, name):
                kind = type(getattr(cls(), name))
                setattr(conf, name, value if kind is type(None) else kind(value))
            else:
                conf.extra[key] = value
        if not conf.bos_feature:
            raise ValueError("bos-feature is empty")
        return conf

    def lines(self) -> list[str]:
        """The settings that differ from the defaults, as lines of a settings file."""
        plain = asdict(EngineConf())
        own = {k.replace("_", "-"): v for k, v in asdict(self).items() if k != "extra" and v != plain[k]}
        return [f"{k} = {v}" for k, v in (own | self.extra).items()]

    def formats(self, key: str | None) -> EngineConf:
        """The settings with the named set of formats; missing ones of the set are empty."""
        if key is None:
            return self
        named = {k: self.extra.get(f"{k}-format-{key}", "") for k in ("node", "unk", "bos", "eos", "eon")}
        if not named["node"]:
            raise ValueError(f"unknown format {key}")
        return EngineConf(**{**asdict(self), **{f"{k}_format": v for k, v in named.items()}})

    def penalties(self) -> dict[int, int]:
        """Cost of a leading blank by part of speech; of repeated ones the first counts."""
        cells = [int(x) for x in self.left_space_penalty_factor.split(",") if x.strip()]
        out: dict[int, int] = {}
        for pos, cost in zip(cells[::2], cells[1::2], strict=False):
            out.setdefault(pos, cost)
        return out


def csv_split(line: str, limit: int | None = None) -> list[str]:
    """CSV fields; blanks before a field go, quotes are undone, the field at the limit keeps the rest as it stands, a trailing empty one goes."""
    out, at, n = [], 0, len(line)
    while at < n:
        while at < n and line[at] in " \t":
            at += 1
        if limit and len(out) == limit - 1:
            out.append(line[at:])
            return out
        if at < n and line[at] == '"':
            value, at = "", at + 1
            while at < n:
                if line[at] == '"':
                    if line[at + 1 : at + 2] != '"':
                        break
                    at += 1
                value, at = value + line[at], at + 1
            stop = line.find(",", at)
        else:
            stop = line.find(",", at)
            value = line[at : stop if stop >= 0 else n]
        out.append(value)
        if stop < 0:
            break
        at = stop + 1
    return out


def csv_quote(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if "," in value or '"' in value else value


@dataclass
class Model:
    conf: EngineConf
    class_names: list[str]
    invoke: np.ndarray
    group: np.ndarray
    length: np.ndarray
    char_class: np.ndarray  # 65536, class of each code point
    char_mask: np.ndarray  # 65536, bits of all its classes
    surfaces: list[bytes]  # distinct, rising
    first: np.ndarray  # entries of a surface: first[i] to first[i + 1]
    left: np.ndarray  # per entry; dictionary entries by (surface, dictionary, order), then unknown ones by class
    right: np.ndarray
    pos: np.ndarray
    cost: np.ndarray
    dict_id: np.ndarray
    features: list[str]
    unknown: np.ndarray  # entries of class c: unknown[c] to unknown[c + 1]
    matrix: np.ndarray  # [right context of the left token, left context of the right one]

    @property
    def size(self) -> int:
        return sum(map(len, self.surfaces)) + sum(map(len, self.features)) + self.matrix.nbytes + 40 * len(self.left)

    @classmethod
    def build(
        cls,
        entries: Iterable[tuple],
        conf: EngineConf | None = None,
        chars: str = MINIMAL_CHARS,
        unknown: str = MINIMAL_UNKNOWN,
        matrix: str | np.ndarray = MINIMAL_MATRIX,
        pos_id=None,
    ) -> Model:
        """entries: (surface, left, right, cost, feature[, dict_id[, pos_id]]) in dictionary order."""
        conf = conf or EngineConf()
        names, flags, ranges = read_chars(chars)
        pos_of = pos_id or (lambda feature: 1)
        char_class, char_mask = np.zeros(65536, np.int16), np.zeros(65536, np.int32)
        default = names.index("DEFAULT")
        char_class[:], char_mask[:] = default, 1 << default
        for low, high, classes in ranges:
            ids = [names.index(c) for c in classes]
            char_class[low : high + 1], char_mask[low : high + 1] = ids[0], sum(1 << i for i in set(ids))
        char_class[65535], char_mask[65535] = default, 1 << default
        rows = []
        for k, e in enumerate(entries):
            surface = e[0].encode() if isinstance(e[0], str) else e[0]
            if surface:
                rows.append((surface, e[5] if len(e) > 5 else 0, k, e[1], e[2], e[3], e[4], e[6] if len(e) > 6 else pos_of(e[4])))
        rows.sort(key=lambda r: r[:3])
        surfaces, first = [], []
        for k, r in enumerate(rows):
            if not surfaces or surfaces[-1] != r[0]:
                surfaces.append(r[0])
                first.append(k)
        first.append(len(rows))
        by_class: dict[str, list] = {n: [] for n in names}
        for line in unknown.splitlines():
            if line.strip():
                name, a, b, c, feature = csv_split(line, 5)
                by_class[name].append((b"", -1, 0, int(a), int(b), int(c), conf.unk_feature or feature, pos_of(feature)))
        missing = [n for n in names if not by_class[n]]
        if missing:
            raise ValueError(f"no unknown-word entries for {missing}")
        bounds = [len(rows)]
        for n in names:
            rows += by_class[n]
            bounds.append(len(rows))
        column = lambda i, kind: np.array([r[i] for r in rows], kind)
        table = read_matrix(matrix) if isinstance(matrix, str) else np.asarray(matrix)
        m = cls(
            conf, names, np.array([f[0] for f in flags]), np.array([f[1] for f in flags]), np.array([f[2] for f in flags]), char_class, char_mask, surfaces,
            np.array(first, np.int64), column(3, np.int64), column(4, np.int64), column(7, np.int64), column(5, np.int64), column(1, np.int64), [r[6] for r in rows], np.array(bounds, np.int64), table.astype(np.int64),
        )
        if len(rows) and (m.left.max() >= table.shape[1] or m.right.max() >= table.shape[0] or m.left.min() < 0 or m.right.min() < 0):
            raise ValueError("a context id is outside of the matrix")
        return m

    def transition_cost(self, right_id: int, left_id: int) -> int:
        return int(self.matrix[right_id, left_id])

    def dictionary_info(self) -> list[dict]:
        """Entries, and sizes of the matrix, of each dictionary (-1: unknown words)."""
        ids, counts = np.unique(self.dict_id, return_counts=True)
        kind = lambda i: 2 if i < 0 else int(i > 0)
        return [{"dict_id": int(i), "type": kind(i), "size": int(n), "lsize": self.matrix.shape[0], "rsize": self.matrix.shape[1], "charset": "utf-8", "version": 102} for i, n in zip(ids, counts, strict=True)]

    def compatible(self, other: Model) -> bool:
        return self.matrix.shape == other.matrix.shape

    def with_user_entries(self, entries: Sequence[tuple], dict_id: int = 1) -> Model:
        """The model with one more dictionary, whose entries come after the others of a surface."""
        known = []
        for i, s in enumerate(self.surfaces):
            for k in range(self.first[i], self.first[i + 1]):
                known.append((s, int(self.left[k]), int(self.right[k]), int(self.cost[k]), self.features[k], int(self.dict_id[k]), int(self.pos[k])))
        lines = []
        for c, name in enumerate(self.class_names):
            for k in range(self.unknown[c], self.unknown[c + 1]):
                lines.append(f"{name},{self.left[k]},{self.right[k]},{self.cost[k]},{self.features[k]}")
        pos = {self.features[k]: int(self.pos[k]) for k in range(len(self.left))}
        new = [(*e[:5], dict_id, e[6] if len(e) > 6 else pos.get(e[4], 1)) for e in entries]
        model = Model.build(known + new, self.conf, self._chars(), "\n".join(lines), self.matrix, lambda f: pos.get(f, 1))
        model.char_class, model.char_mask = self.char_class, self.char_mask
        return model

    def _chars(self) -> str:
        return "\n".join(f"{n} {int(i)} {int(g)} {int(k)}" for n, i, g, k in zip(self.class_names, self.invoke, self.group, self.length, strict=True))


def read_chars(text: str) -> tuple[list[str], list[tuple[bool, bool, int]], list[tuple[int, int, list[str]]]]:
    """Class names, (invoke, group, length) and (low, high, classes) ranges of a character definition."""
    names, flags, ranges = [], [], []
    for line in text.splitlines():
        cells = line.split("#", 1)[0].split()
        if not cells:
            continue
        if cells[0].startswith("0x"):
            low, _, high = cells[0].partition("..")
            ranges.append((int(low, 16), min(int(high or low, 16), 65534), cells[1:]))
        else:
            names.append(cells[0])
            flags.append((cells[1] == "1", cells[2] == "1", int(cells[3])))
    if "DEFAULT" not in names or "SPACE" not in names:
        raise ValueError("DEFAULT and SPACE must be defined")
    if len(names) > 18:
        raise ValueError("at most 18 classes")
    return names, flags, ranges


def read_matrix(text: str) -> np.ndarray:
    rows = [x.split() for x in text.splitlines() if x.strip()]
    table = np.zeros((int(rows[0][0]), int(rows[0][1])), np.int64)
    for a, b, c in rows[1:]:
        table[int(a), int(b)] = int(c)
    return table
