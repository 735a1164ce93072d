"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

All segmentations of a text into pieces form a lattice. Piece probabilities follow
the vocabulary's own ranks (Zipf's law; the tokenizer is never trained), and the
mass of all ways on from each lattice node is summed backwards once. Sampling k
distinct segmentations is then a best-first search over perturbed prefixes: a
prefix's priority is the largest Gumbel-perturbed log-probability among its
completions, which the summed mass gives exactly. The best completion of a prefix
is walked forwards; every piece on its way leaves the prefix "anything but this
piece" with a Gumbel truncated by its parent's. What is best after k samples is
the threshold of their inclusion probabilities.

A text splits wherever no piece has its two neighbours side by side, for one before
each space. Lattices are built for the distinct units between these cuts; a task
keeps them for the batches that follow: beyond ``KEPT_CHARS`` characters the units met
most often stay, up to half of that. All arrays run over some ``HELD_CHARS`` bytes of
texts. Random numbers are hashes of row key, copy, place and step, and a unit's
numbers are summed by themselves: results don't depend on batches or what was kept.

Characters that no piece covers become byte pieces; a literal U+2581 does too, so
decoding gives back every text exactly.

Defined cases: a null text counts as empty; an empty text has one segmentation,
without pieces; a text with fewer than k segmentations returns them all, with
inclusion 1; an empty table gives no rows; rows equal in key and text are numbered by
``copy``, wherever they lie, and sampled each for itself; a text of any length is one
lattice walk, in memory in proportion to its pieces; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches
from spanframe.plans.bitmap import split
from spanframe.plans.scratch import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, HELD_CHARS, KEPT_CHARS = 2, 17, 300_000, 300_000
SPACE, LITERAL = "▁", "\ud800"  # the second stands for a literal U+2581: no text holds a surrogate
STOP = 0xDFFF
NAMES = ["key", "copy", "sample", "ids", "log_prob", "perturbed", "inclusion", "exact"]
DENSE = 128
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit states."""
    return ((_mix(x) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(x)))


def _below(bound: float, value: float) -> float:
    """A Gumbel variable, truncated at ``bound``."""
    with np.errstate(over="ignore"):
        return float(-np.logaddexp(-bound, -value))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each ``low`` up to its ``high``, which is left out, end to end."""
    size = high - low
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Vocabulary:
    """The pieces as a trie in arrays, and their log-probabilities."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        usable, special = [], set()
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                special.add(i)
            else:
                usable.append(i)
        places = np.arange(1, n + 1)
        log_total = np.log((1.0 / places).sum())
        rank = {i: k for k, i in enumerate(sorted(usable, key=lambda i: (-sp.get_score(i), i)), 1)}
        self.byte_logp = -np.log(n) - log_total
        counts = Counter(c for i in usable for c in names[i])
        chars = sorted(counts, key=lambda c: (-counts[c], c))
        self.code = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.code[ord(c)] = k
        edges: dict[tuple[int, int], int] = {}
        piece, logp = [-1], [0.0]
        for i in usable:
            node = 0
            for c in names[i]:
                step = (node, int(self.code[ord(c)]))
                if step not in edges:
                    edges[step] = len(piece)
                    piece.append(-1)
                    logp.append(0.0)
                node = edges[step]
            piece[node], logp[node] = i, -np.log(rank[i]) - log_total
        self.piece, self.logp = np.array(piece, np.int32), np.array(logp)
        self.dense = np.full((len(piece), DENSE), -1, np.int32)
        rest = {}
        for (node, code), to in edges.items():
            if code < DENSE:
                self.dense[node, code] = to
            else:
                rest[node << 32 | code] = to
        self.rest_keys = np.array(sorted(rest), np.int64)
        self.rest_to = np.array([rest[k] for k in sorted(rest)], np.int32)
        pairs = {(int(self.code[ord(a)]), int(self.code[ord(b)])) for i in usable for a, b in zip(names[i], names[i][1:])}
        self.beside = np.zeros((DENSE, DENSE), bool)
        for a, b in pairs:
            if a < DENSE and b < DENSE:
                self.beside[a, b] = True
        self.rest_pairs = np.array(sorted(a << 32 | b for a, b in pairs if a >= DENSE or b >= DENSE), np.int64)
        self.longest = max(len(names[i]) for i in usable)
        self.raw = np.empty(n, object)
        self.raw[:] = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if i in special else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, n)
        self.raw_arrow = pa.array(self.raw.tolist(), pa.large_binary())

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        common = code < DENSE
        to = self.dense[node, np.where(common, code, 0)]
        if len(self.rest_keys) and not common.all():
            rare = np.flatnonzero(~common)
            key = node[rare].astype(np.int64) << 32 | code[rare]
            at = np.minimum(np.searchsorted(self.rest_keys, key), len(self.rest_keys) - 1)
            to[rare] = np.where(self.rest_keys[at] == key, self.rest_to[at], -1)
        return to

    def joints(self, points: np.ndarray) -> np.ndarray:
        """Whether some piece has each point and the next one side by side."""
        code = self.code[points]
        a, b = code[:-1], code[1:]
        common = (a < DENSE) & (b < DENSE)
        out = common & self.beside[np.where(common, a, 0), np.where(common, b, 0)]
        rare = np.flatnonzero(~common)
        if len(rare) and len(self.rest_pairs):
            key = a[rare].astype(np.int64) << 32 | b[rare]
            out[rare] = self.rest_pairs[np.minimum(np.searchsorted(self.rest_pairs, key), len(self.rest_pairs) - 1)] == key
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of any encoding; the space put before the text is taken off."""
        return b"".join(self.raw[ids].tolist())[1:].decode("utf-8", "replace") if len(ids) else ""


class Lattice:
    """The lattices of distinct units, end to end: node = character position, edge = piece or byte-coded character."""

    def __init__(self, vocabulary: Vocabulary, points: np.ndarray, length: np.ndarray) -> None:
        # each unit ends in a node of its own: no character follows there, and its mass is 1
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        n = len(points) + len(length)
        stop = np.zeros(n, bool)
        stop[self.end] = True
        self.points = np.full(n, STOP, np.uint32)
        self.points[~stop] = points
        points = self.points
        code = vocabulary.code[points]
        at = np.flatnonzero(~stop).astype(np.int32)
        node, found = np.zeros(len(at), np.int32), []
        bare_at = stop.copy()
        for k in range(vocabulary.longest):
            if not len(at):
                break
            node = vocabulary.step(node, code[at + k])
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive]
            piece = vocabulary.piece[node]
            whole = np.flatnonzero(piece >= 0)
            hit = at[whole]
            if k == 0:
                bare_at[hit] = True
            found.append((hit, k + 1, piece[whole], vocabulary.logp[node[whole]]))
        bare = np.flatnonzero(~bare_at)  # no piece for the character alone: bytes
        width = 1 + (points[bare] > 0x7F) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
        found.append((bare, 1, -1 - points[bare].astype(np.int32), width * vocabulary.byte_logp))
        # edges by position; long pieces come first, as they are likely ones
        self.degree = np.zeros(n, np.int32)
        for hit, *_ in found:
            self.degree[hit] += 1
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        total = int(self.first[-1])
        self.at = np.repeat(np.arange(n, dtype=np.int32), self.degree)
        self.to, self.piece, ways = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total)
        free = self.first[:-1].copy()
        for hit, span, piece, chance in reversed(found):
            slot = free[hit]
            self.to[slot], self.piece[slot], ways[slot] = hit + span, piece, chance
            free[hit] = slot + 1
        # backward sums, all positions at one distance from their unit's end at once
        left = np.repeat(self.end, length + 1) - np.arange(n)
        longest = int(left.max()) if len(left) else 0
        order = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, longest + 2))
        mass = np.zeros(n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            here = order[a:b]
            edge, most = self.first[here], self.degree[here]
            sums = ways[edge] + mass[self.to[edge]]
            ways[edge] = sums
            more = np.flatnonzero(most > 1)
            t = 1
            while len(more):
                e = edge[more] + t
                way = ways[e] + mass[self.to[e]]
                ways[e] = way
                sums[more] = np.logaddexp(sums[more], way)
                t += 1
                more = more[most[more] > t]
            mass[here] = sums
        self.given = ways - mass[self.at]
        chance = np.exp(self.given)
        # summed node by node, so that a unit's numbers don't depend on what else is in the batch
        self.upto = chance.copy()
        more, t = np.flatnonzero(self.degree > 1), 1
        while len(more):
            e = self.first[more] + t
            self.upto[e] += self.upto[e - 1]
            t += 1
            more = more[self.degree[more] > t]
        self.upto[self.first[1:][self.degree > 0] - 1] = np.inf  # rounding never leaves a node without an edge
        self.room: dict[str, np.ndarray] = {}

    def extend(self, more: Lattice) -> None:
        """Add ``more``, its nodes and edges numbered behind those that are here; what is here is copied only when its room is full."""
        nodes, edges = len(self.degree), len(self.to)
        shifts = {"start": nodes, "end": nodes, "at": nodes, "to": nodes, "first": edges}
        for name in ("points", "degree", "piece", "given", "upto", *shifts):
            own, new = getattr(self, name), getattr(more, name)[1 if name == "first" else 0 :]
            size = len(own) + len(new)
            room = self.room.get(name)
            if room is None or len(room) < size:
                room = np.empty(max(size, len(own) * 3 // 2), own.dtype)
                room[: len(own)] = own
                self.room[name] = room
            room[len(own) : size] = new + new.dtype.type(shifts[name]) if name in shifts else new
            setattr(self, name, room[:size])

    def only(self, units: np.ndarray) -> None:
        """Keep these units alone, in the order given."""
        start, end = self.start[units], self.end[units]
        low, high = self.first[start], self.first[end]
        nodes, edges = _ranges(start, end + 1), _ranges(low, high)
        self.end = np.cumsum(end + 1 - start) - 1
        self.start = self.end - (end - start)
        shift = np.repeat(self.start - start, high - low).astype(np.int32)
        self.room = {}
        for name in ("points", "degree"):
            setattr(self, name, getattr(self, name)[nodes])
        for name in ("at", "to", "piece", "given", "upto"):
            setattr(self, name, getattr(self, name)[edges])
        self.at += shift
        self.to += shift
        self.first = np.concatenate([[0], np.cumsum(self.degree)])

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first[at]
        open_ = np.flatnonzero(u > self.upto[edge])
        while len(open_):
            edge[open_] += 1
            open_ = open_[u[open_] > self.upto[edge[open_]]]
        return edge


class Sampler:
    """k distinct segmentations of each text of a batch."""

    def __init__(self, vocabulary: Vocabulary, k: int, seed: int, kept_chars: int = KEPT_CHARS) -> None:
        self.vocabulary, self.k, self.seed, self.kept_chars = vocabulary, k, seed, kept_chars
        self._forget(1)

    def _forget(self, mixer: int) -> None:
        """No lattice is kept; units are told apart by hashes that ``mixer`` seeds."""
        self.mixer, self.keys, self.number, self.uses = mixer, np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lattice = Lattice(self.vocabulary, np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _shrink(self) -> None:
        """Half of what may be kept stays: the units met most often, earlier meetings counting half at each time."""
        often = np.argsort(-self.uses, kind="stable")
        room = np.cumsum((self.lattice.end - self.lattice.start + 1)[often])
        kept = np.sort(often[: np.searchsorted(room, self.kept_chars // 2, side="right")])
        if not len(kept):
            return self._forget(self.mixer)
        self.lattice.only(kept)
        self.uses = self.uses[kept] // 2
        place = np.full(len(room), -1)
        place[kept] = np.arange(len(kept))
        number = place[self.number]
        self.keys, self.number = self.keys[number >= 0], number[number >= 0]

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, end to end, by their numbers in the lattice, and how many each text has."""
        whole = "".join([" " + x for x in texts if x])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        literal = points == ord(SPACE)
        points[points == 32] = ord(SPACE)
        points[literal] = ord(LITERAL)
        size = np.fromiter((len(x) + 1 if x else 0 for x in texts), np.int64, len(texts))
        opens = np.ones(len(points), bool)
        if len(points):
            np.logical_not(self.vocabulary.joints(points), out=opens[1:])
            opens[(np.cumsum(size) - size)[size > 0]] = True
        start = np.flatnonzero(opens)
        if len(self.lattice.degree) > self.kept_chars:
            self._shrink()
        unit = self._numbered(points, start)
        while not self._same(points, start, unit):  # two units with one hash
            self._forget(self.mixer + 1)
            unit = self._numbered(points, start)
        self.uses += np.bincount(unit, minlength=len(self.uses))
        return unit, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])))

    def _numbered(self, points: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The number of each unit; those that are new get lattices."""
        length = np.diff(np.append(start, len(points)))
        if not len(start):
            return np.zeros(0, np.int64)
        powers = np.multiply.accumulate(np.full(int(length.max()), U64(0x9E3779B97F4A7C15)))
        value = _mix(points.astype(U64) + U64(self.mixer << 32))
        value *= powers[np.arange(len(points)) - np.repeat(start, length)]
        code, keys = pd.factorize(np.add.reduceat(value, start))
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        number = np.zeros(len(keys), np.int64)
        number[known] = self.number[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            number[fresh] = len(self.lattice.start) + np.arange(len(fresh))
            once = np.zeros(len(keys), np.int64)
            once[code[::-1]] = np.arange(len(code))[::-1]  # where each is met first
            begin, size = start[once[fresh]], length[once[fresh]]
            more = Lattice(self.vocabulary, points[_ranges(begin, begin + size)], size)
            if len(self.lattice.start):
                self.lattice.extend(more)
            else:
                self.lattice = more
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
            new = fresh[np.argsort(keys[fresh])]
            self.keys, self.number = np.insert(self.keys, place[new], keys[new]), np.insert(self.number, place[new], number[new])
        return number[code]

    def _same(self, points: np.ndarray, start: np.ndarray, unit: np.ndarray) -> bool:
        """Whether every unit is, point by point, that of its number."""
        lat = self.lattice
        length = np.diff(np.append(start, len(points)))
        if not np.array_equal(length, lat.end[unit] - lat.start[unit]):
            return False
        return np.array_equal(lat.points[np.repeat(lat.start[unit] - start, length) + np.arange(len(points))], points)

    def _walk(self, occurrence: np.ndarray, at: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, edge) of the pieces drawn from ``at`` to the end of each unit, in order."""
        lat, drawn = self.lattice, []
        end = lat.end[self.unit[occurrence]]
        state = _mix(self.state[occurrence] + U64(stream * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        step, count = 0, np.zeros(len(occurrence), np.int64)
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            edge = lat.pick(at, _uniform(state[live] + U64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)))
            drawn.append((live, edge))
            count[live] += 1
            at = lat.to[edge]
            more = at < end[live]
            live, at = live[more], at[more]
            step += 1
        begin, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        for step, (live, edge) in enumerate(drawn):
            out[begin[live] + step] = edge
        return np.repeat(occurrence, count), out

    def _siblings(self, occurrence, edge, before, stream, taken=None) -> np.ndarray:
        """Perturbed maxima of "any other piece here", not yet truncated, which keeps their order; ``taken`` gives chance and number of pieces already out, row by row."""
        lat = self.lattice
        at, chance, out = lat.at[edge], np.exp(lat.given[edge]), np.ones(len(edge), np.int64)
        if taken is not None:
            where, extra, more = taken
            chance[where] += extra
            out[where] += more
        gone = (out >= lat.degree[at]) | (chance >= 1)
        wait = -np.log(_uniform(_mix(self.state[occurrence] ^ U64(0x94D049BB133111EB)) + (at - lat.start[self.unit[occurrence]]).astype(U64) * U64(0xD1B54A32D192ED03) + U64((stream + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)))
        with np.errstate(divide="ignore"):
            return before + np.log(np.where(gone, 0.0, 1 - chance) / wait)

    def __call__(self, seeds: np.ndarray, texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples, the best first: edges, log-probability, perturbed value, inclusion probability."""
        n = len(texts)
        self.unit, sizes = self._units(texts)
        lat = self.lattice
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(n), sizes)
        seeds = _mix(seeds.astype(U64) + U64(self.seed))
        self.state = _mix(seeds[owner] + (np.arange(len(owner)) - begins[owner]).astype(U64) * U64(0x9E3779B97F4A7C15)) if len(owner) else np.zeros(0, U64)

        occurrence, edge = self._walk(np.arange(len(owner)), lat.start[self.unit], 0)
        doc = owner[occurrence]
        cut = np.searchsorted(doc, np.arange(n + 1))
        gained = [np.cumsum(lat.given[edge[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        bound = _gumbel(seeds ^ U64(0xBF58476D1CE4E5B9))
        before = np.concatenate([np.zeros(0), *gained]) - lat.given[edge]
        value = self._siblings(occurrence, edge, before, 0)
        # for each text: its samples and, for each, the prefixes that leave it, as (values, place of the first, pieces out at it, bound)
        samples = [[(edge[a:b], occurrence[a:b], float(gained[d][-1]) if b > a else 0.0, float(bound[d]))] for d, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
        leaving = [[(value[a:b].copy(), 0, (), bound[d])] for d, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
        for stream in range(1, self.k + 1):
            chosen = []
            for d in range(n):
                best = max(((_below(most, v.max()), s) for s, (v, _, _, most) in enumerate(leaving[d]) if len(v)), default=(-np.inf, -1))
                chosen.append(best)
            if stream == self.k:
                break
            self._next(stream, chosen, samples, leaving, begins, ends)
        out = []
        for mine, (threshold, _) in zip(samples, chosen):
            with np.errstate(over="ignore"):
                out.append([(edges, logp, perturbed, float(-np.expm1(-np.exp(logp - threshold)))) for edges, _, logp, perturbed in mine])
        return out

    def _next(self, stream, chosen, samples, leaving, begins, ends) -> None:
        """Take the best prefix of each text, complete it, and add the prefixes that leave the new sample."""
        lat = self.lattice
        todo = []
        for d, (value, s) in enumerate(chosen):
            if value == -np.inf:
                continue
            values, offset, out, _ = leaving[d][s]
            j = int(values.argmax())
            values[j] = -np.inf
            edges, occ = samples[d][s][:2]
            place = offset + j
            excluded = (*(out if j == 0 else ()), int(edges[place]))
            at, where = int(lat.at[edges[place]]), int(occ[place])
            u = float(_uniform(_mix(self.state[where : where + 1] + U64(stream * 0xA24BAED4963EE407 & (1 << 64) - 1)) ^ U64(at - int(lat.start[self.unit[where]])))[0])
            free = [e for e in range(lat.first[at], lat.first[at + 1]) if e not in excluded]
            chances = np.exp(lat.given[free])
            forced = free[min(int(np.searchsorted(np.cumsum(chances), u * chances.sum())), len(free) - 1)]
            todo.append((d, value, s, place, excluded, forced, where))
        if not todo:
            return
        spans = [np.arange(where, ends[d]) for d, *_, where in todo]
        occurrence = np.concatenate(spans)
        at = lat.start[self.unit[occurrence]]
        heads = np.cumsum([0, *map(len, spans[:-1])])
        at[heads] = [lat.to[forced] for *_, forced, _ in todo]
        drawn_occ, drawn_edge = self._walk(occurrence, at, stream)
        # the occurrences of a text are a range, so its drawn pieces are one too
        lows = np.searchsorted(drawn_occ, [x[6] for x in todo])
        highs = np.searchsorted(drawn_occ, [ends[x[0]] for x in todo])
        tails, lengths = [], []
        for (d, value, s, place, excluded, forced, where), a, b in zip(todo, lows, highs):
            edges, occ = samples[d][s][:2]
            tail_e, tail_o = np.concatenate([[forced], drawn_edge[a:b]]), np.concatenate([[where], drawn_occ[a:b]])
            head = float(lat.given[edges[:place]].sum())
            gained = np.cumsum(lat.given[tail_e])
            samples[d].append((np.concatenate([edges[:place], tail_e]), np.concatenate([occ[:place], tail_o]), head + float(gained[-1]), value))
            tails.append((tail_e, tail_o, head + gained - lat.given[tail_e]))
            lengths.append(len(tail_e))
        first = np.cumsum([0, *lengths[:-1]])
        gone = np.array([np.exp(lat.given[list(x[4])]).sum() for x in todo])
        taken = (first, gone, np.array([len(x[4]) for x in todo]))
        values = self._siblings(np.concatenate([t[1] for t in tails]), np.concatenate([t[0] for t in tails]), np.concatenate([t[2] for t in tails]), stream, taken)
        for (d, value, _, place, excluded, _, _), a, b in zip(todo, first, first + lengths):
            leaving[d].append((values[a:b].copy(), place, excluded, value))

    def ids(self, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of samples, end to end, and where each begins; byte-coded characters are spelled out."""
        flat = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        piece = self.lattice.piece[flat] if len(flat) else np.zeros(0, np.int64)
        bare = np.flatnonzero(piece < 0)
        width = np.ones(len(piece), np.int64)
        out = piece
        if len(bare):
            kinds, which = np.unique(piece[bare], return_inverse=True)
            spelled = [self.vocabulary.byte_id[list((chr(-1 - p) if -1 - p != ord(LITERAL) else SPACE).encode("utf-8", "surrogatepass"))] for p in kinds.tolist()]
            sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
            width[bare] = sizes[which]
            out = np.repeat(piece, width)
            at, begin = (np.cumsum(width) - width)[bare], (np.cumsum(sizes) - sizes)[which]
            out[_ranges(at, at + sizes[which])] = np.concatenate(spelled)[_ranges(begin, begin + sizes[which])]
        ends = np.concatenate([[0], np.cumsum(width)])
        return out.astype(np.int32, copy=False), ends[np.concatenate([[0], np.cumsum([len(e) for e in edges])]).astype(np.int64)]


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in order, put together or cut to some ``size`` bytes of their second column, a longer text by itself."""
    held, sum_ = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            gone = int(ends[at - 1]) if at else 0
            upto = max(int(np.searchsorted(ends, gone + size - sum_, side="right")), at if held else at + 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                sum_ += int(ends[upto - 1]) - gone
            if upto < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, sum_ = [], 0
            at = upto
    if held:
        yield pa.Table.from_batches(held)


def sampled(batches: Iterator[pa.RecordBatch], sampler: Sampler) -> Iterator[pa.RecordBatch]:
    """The samples of rows (key, text, hash of a copy, number of a copy), some ``HELD_CHARS`` bytes of text at once."""
    from xxhash import xxh64_intdigest

    raw = sampler.vocabulary.raw_arrow
    met: Counter = Counter()  # of the copies in this partition: a number each

    def copies(keys: list, hashes: list[int | None], given: list[int | None]) -> list[int]:
        out = []
        for row, number in zip(zip(keys, hashes), given):
            out.append(met[row] if number is None else number)
            if number is None:
                met[row] += 1
        return out

    def done(table: pa.Table) -> pa.RecordBatch:
        keys, texts = table.column(0).combine_chunks(), table.column(1).to_pylist()
        copy_of = copies(keys.to_pylist(), table.column(2).to_pylist(), table.column(3).to_pylist())
        texts = [x or "" for x in texts]
        seeds = np.fromiter((xxh64_intdigest(str(x).encode()) for x in keys.to_pylist()), U64, len(texts))
        seeds += np.array(copy_of, U64) * U64(0xD6E8FEB86659FD93)
        found = sampler(seeds, texts)
        row = [d for d, mine in enumerate(found) for _ in mine]
        flat = [s for mine in found for s in mine]
        ids, bounds = sampler.ids([s[0] for s in flat])
        # decoded at once: the bytes of all pieces, cut where samples end, less the space put before each text
        ends, data = np.zeros(1, np.int64), b""
        if len(ids):
            _, places, blob = raw.take(pa.array(ids)).buffers()
            ends, data = np.frombuffer(places, np.int64, len(ids) + 1), blob.to_pybytes()
        cuts = ends[bounds].tolist()
        whole = [b" " + x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
        exact = [data[a:b] == whole[d] for d, a, b in zip(row, cuts[:-1], cuts[1:])]
        columns = [keys.take(pa.array(row, pa.int64())), pa.array(np.array(copy_of, np.int32)[row]), pa.array([i for mine in found for i in range(len(mine))], pa.int32()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
        columns += [pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(exact, pa.bool_())], names=NAMES)

    yield from map(done, pieces(batches, HELD_CHARS))


def sample(spark: SparkSession, docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, sample, ids, log_prob, perturbed, inclusion, exact): up to ``k`` rows for each row of ``docs``.

    ``exact`` says that decoding ``ids`` gave back the text. Rows equal in key and text are copies, numbered from 0
    wherever they lie: hashes are counted first. Copies that lie in one partition are numbered there; only those that
    lie in several are shuffled. So that partitions are the same when they are read again, what doesn't come straight from
    files is written first.
    """
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    if not docs.inputFiles() or "Exchange" in docs._jdf.queryExecution().sparkPlan().toString() or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        rows = stored(spark, rows, "rows")
    same = F.struct("key", F.xxhash64("text").alias("t"))
    placed = rows.select(same.alias("same"), F.spark_partition_id().alias("part"))
    counts = placed.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("n > 1")
    often = stored(spark, counts.select("same", (F.col("low") < F.col("high")).alias("apart")), "copies")
    maybe, once = split(spark, rows, same, often, F.col("same"))
    apart, beside = split(spark, maybe, same, often.filter("apart"), F.col("same"))
    numbered = F.row_number().over(Window.partitionBy("key", F.xxhash64("text")).orderBy(F.lit(0))) - 1
    unknown = F.lit(None).cast("int")
    rows = once.withColumns({"t": F.lit(None).cast("long"), "copy": F.lit(0)}).unionByName(beside.withColumns({"t": F.xxhash64("text"), "copy": unknown})).unionByName(apart.withColumns({"t": F.lit(None).cast("long"), "copy": numbered}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sampled(batches, Sampler(vocabulary(model), k, seed))

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, copy int, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, exact boolean").withColumnRenamed("key", key)


def decode(ids_column, model: str = MODEL):
    """A column of texts from a column of piece ids."""

    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else vocabulary(model).decode(np.asarray(x, np.int64)))

    return F.pandas_udf(run, "string")(ids_column)


def op6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sample(spark, docs)
