"""Row images of many events at once: the same values as ``codec.rows`` gives, read column by column into Arrow arrays.

Events of one table map and kind are walked side by side: step k reads the k-th row of all of them, a column at a time, with
a place for each event. This knows the usual layouts only. Whatever isn't usual (absent columns, other counts, values that
are cut off, rare types) leaves its event to ``codec.rows``, which reads it or says what is wrong.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from rowtide.functions import codec as C
from rowtide.functions.errors import LogError

#: With fewer events side by side, one at a time is faster.
LEAST = 8
STRINGS = {C.VARCHAR, C.VAR_STRING, C.STRING}
BLOBS = {C.TINY_BLOB, C.MEDIUM_BLOB, C.LONG_BLOB, C.BLOB, C.VECTOR, C.JSON, C.GEOMETRY, C.BLOB_COMPRESSED, C.TYPED_ARRAY}
KINDS = pa.array(["NULL", "INT", "DOUBLE", "STRING", "BYTES"])
NULL, INT, DOUBLE, STRING, BYTES = range(5)
_TEN = 10 ** np.arange(19, dtype=np.int64)


def _spelled(parts: list[tuple[np.ndarray | str, np.ndarray | bool]], n: int) -> pa.Array:
    """Texts of characters (digits as numbers from 0 to 9, or one fixed character), each with whether a row has it."""
    shown, kept = np.empty((n, len(parts)), np.uint8), np.empty((n, len(parts)), bool)
    for k, (what, there) in enumerate(parts):
        shown[:, k] = ord(what) if isinstance(what, str) else what + 48
        kept[:, k] = there
    return _texts(shown[kept], kept.sum(axis=1), pa.string())


def _texts(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _digits(value: np.ndarray, least: int, most: int) -> list[tuple[np.ndarray, np.ndarray | bool]]:
    """Decimal digits, zeros in front only up to ``least``."""
    return [(value // _TEN[k] % 10, True if k < least else value >= _TEN[k]) for k in reversed(range(most))]


def _fraction(micros: np.ndarray, fsp: int) -> list:
    return [(".", True), *_digits(micros, 6, 8)] if fsp else []  # damaged ones can have more digits


class Layout:
    """How a column lies in a row image; ``None`` from ``of`` means that it is left to ``codec``."""

    def __init__(self, kind: int, form: str, size: int, meta: int = 0, signed: bool = True, inflate: int | None = None):
        self.kind, self.form, self.size, self.meta, self.signed, self.inflate = kind, form, size, meta, signed, inflate

    @classmethod
    def of(cls, kind: int, meta: int, unsigned: bool) -> Layout | None:
        if kind in C.INTEGERS:
            return cls(INT, "number", C.INTEGERS[kind], signed=not unsigned)
        if kind == C.YEAR:
            return cls(INT, "year", 1, signed=False)
        if kind == C.TIMESTAMP:
            return cls(INT, "number", 4, signed=False)
        if kind in (C.FLOAT, C.DOUBLE):
            return cls(DOUBLE, "real", 4 if kind == C.FLOAT else 8)
        if kind == C.STRING and meta >> 8 in (C.ENUM, C.SET):
            size = meta & 0xFF
            return cls(INT, "number", size, signed=size == 8) if 1 <= size <= (2 if meta >> 8 == C.ENUM else 8) else None
        if kind == C.BIT:
            size = (meta >> 8) + bool(meta & 0xFF) or 1
            return cls(INT, "turned", size, signed=size == 8) if size <= 8 else None
        if kind in STRINGS or kind == C.VARCHAR_COMPRESSED:
            most = (meta >> 4 & 0x300 ^ 0x300) + (meta & 0xFF) if kind == C.STRING else meta
            return cls(STRING, "span", 1 if most <= 255 else 2, inflate=most if kind == C.VARCHAR_COMPRESSED else None)
        if kind in BLOBS:
            size = 4 if kind == C.TYPED_ARRAY else meta or (4 if kind in (C.JSON, C.GEOMETRY) else 1 if kind != C.BLOB_COMPRESSED else 0)
            return cls(BYTES, "span", size, inflate=C.blob_limit(size) if kind == C.BLOB_COMPRESSED else None) if 1 <= size <= 4 else None
        if kind == C.NEWDECIMAL:
            precision, scale = meta >> 8, meta & 0xFF
            whole = precision - scale
            return cls(STRING, "decimal", sum(C.DIGIT_BYTES[x % 9] + x // 9 * 4 for x in (whole, scale)), meta) if 0 <= whole <= 18 and scale <= 18 and precision else None
        if kind == C.DATE:
            return cls(STRING, "date", 3)
        size = {C.DATETIME2: 5, C.TIMESTAMP2: 4, C.TIME2: 3}.get(kind)
        form = {C.DATETIME2: "moment", C.TIMESTAMP2: "stamp", C.TIME2: "clock"}.get(kind, "")
        return cls(STRING, form, size + (meta + 1) // 2, meta) if size and meta <= 6 else None


def plan(table: C.TableMap) -> list[Layout] | None:
    """The layouts of a table's columns, or none if one of them is rare."""
    if not hasattr(table, "layouts"):
        found = [Layout.of(k, m, u) for k, m, u in zip(table.types, table.meta, table.unsigned, strict=True)]
        table.layouts = None if None in found or len(found) > 250 else found
    return table.layouts


class Image:
    """One image (before or after) of the rows read so far: for each column the steps' values and nulls."""

    def __init__(self, layouts: list[Layout], wanted: set[int]):
        self.layouts, self.wanted = layouts, {c for c in wanted if c < len(layouts)}
        self.values: list[list] = [[] for _ in layouts]
        self.nulls: list[list] = [[] for _ in layouts]

    def read(self, data: np.ndarray, eights: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read an image at each place: the places after them, and which were in bounds."""
        ok = at + (len(self.layouts) + 7) // 8 <= end
        first = np.minimum(at, len(data) - 8 - (len(self.layouts) + 7) // 8)
        at = at + (len(self.layouts) + 7) // 8
        for c, layout in enumerate(self.layouts):
            null = (data[first + c // 8] >> (c % 8) & 1).astype(bool)
            here = np.minimum(at, len(eights) - 1)
            keep = c in self.wanted
            if layout.form == "span":
                size = (eights[here] & np.uint64((1 << 8 * layout.size) - 1)).astype(np.int64)
                size[null] = 0
                to = at + np.where(null, 0, layout.size + size)
                value = (np.where(null, 0, here + layout.size), size)
            else:
                value = eights[here]
                if layout.form == "decimal" and keep:
                    value, odd = self._decimal(eights, here, layout)
                    ok &= ~odd | null
                to = at + np.where(null, 0, layout.size)
            ok &= to <= end
            at = np.where(ok, to, end)
            if keep:
                self.values[c].append(value)
                self.nulls[c].append(null)
        return at, ok

    @staticmethod
    def _decimal(eights: np.ndarray, at: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Sign, digits before and after the point of packed decimals; and which have groups of too many digits."""
        whole, scale = (layout.meta >> 8) - (layout.meta & 0xFF), layout.meta & 0xFF
        head = eights[at] & np.uint64(0x80)
        negative, odd, out, at, first = head == 0, np.zeros(len(at), bool), [], at.copy(), True
        for widths in ([whole % 9] + [9] * (whole // 9), [9] * (scale // 9) + [scale % 9]):
            value = np.zeros(len(at), np.int64)
            for width in widths:
                size = C.DIGIT_BYTES[width]
                if not size:
                    continue
                part = (eights[np.minimum(at, len(eights) - 1)].byteswap() >> np.uint64(64 - 8 * size)).astype(np.int64)
                if first:
                    part ^= 1 << 8 * size - 1
                    first = False
                part = np.where(negative, part ^ (1 << 8 * size) - 1, part)
                odd |= part >= 10**width
                value = value * 10**width + part
                at += size
            out.append(value)
        return np.stack([negative.astype(np.int64), *out]), odd

    def close(self, picked: np.ndarray, data: np.ndarray) -> None:
        """Bring the steps together, and inflate what is compressed in the rows picked, which can fail."""
        for c in self.wanted:
            layout, values = self.layouts[c], self.values[c]
            nulls = self.nulls[c] = np.concatenate(self.nulls[c])
            if layout.form != "span":
                self.values[c] = np.concatenate(values, axis=-1)
                continue
            starts, sizes = self.values[c] = tuple(map(np.concatenate, zip(*values, strict=True)))
            if layout.inflate is not None:
                content = np.full(len(starts), None, object)
                for k in picked[~nulls[picked]].tolist():
                    content[k] = C.inflated(data[starts[k] : starts[k] + sizes[k]].tobytes(), layout.inflate)
                self.values[c] = content

    def column(self, c: int, rows: np.ndarray, data: np.ndarray) -> Column:
        layout, values, nulls = self.layouts[c], self.values[c], self.nulls[c][rows]
        if layout.form == "span" and layout.inflate is None:
            return Column(layout, nulls, data=data, starts=values[0][rows], sizes=values[1][rows])
        return Column(layout, nulls, values=values[..., rows])


class Column:
    """The values of a column over rows, as Arrow arrays by kind."""

    def __init__(self, layout: Layout, nulls: np.ndarray, values: np.ndarray | None = None, data: np.ndarray | None = None, starts: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.layout, self.nulls, self.values, self.data, self.starts, self.sizes = layout, nulls, values, data, starts, sizes
        self.kinds = np.where(nulls, NULL, layout.kind)
        self.i = self.d = self.s = self.b = None
        getattr(self, "_" + layout.form)()

    def _masked(self, values, kind: pa.DataType | None = None, without: np.ndarray | None = None) -> pa.Array:
        return pa.array(values, kind, mask=self.nulls if without is None else self.nulls | without)

    def _with_nulls(self, found: pa.Array) -> pa.Array:
        if not self.nulls.any():
            return found
        bits = np.packbits(~self.nulls, bitorder="little")
        return pa.Array.from_buffers(found.type, len(found), [pa.py_buffer(bits), *found.buffers()[1:]])

    def _number(self) -> None:
        size = self.layout.size
        value = self.values & np.uint64((1 << 8 * size) - 1)
        large = np.zeros(len(value), bool)
        if not self.layout.signed and size == 8:
            large = (value >> np.uint64(63)).astype(bool) & ~self.nulls
        number = value.astype(np.int64)
        if self.layout.signed and size < 8:
            number = (number ^ 1 << 8 * size - 1) - (1 << 8 * size - 1)
        self.i = self._masked(number, without=large)
        if large.any():  # too large for a signed number: its digits
            self.kinds[large] = STRING
            self.s = pa.array([str(x) if there else None for x, there in zip(value.tolist(), large.tolist(), strict=True)], pa.string())

    def _turned(self) -> None:
        self.i = self._masked((self.values.byteswap() >> np.uint64(64 - 8 * self.layout.size)).astype(np.int64))

    def _year(self) -> None:
        year = (self.values & np.uint64(0xFF)).astype(np.int64)
        self.i = self._masked(np.where(year > 0, year + 1900, 0))

    def _real(self) -> None:
        small = self.layout.size == 4
        with np.errstate(invalid="ignore"):  # numbers that are none stay none
            self.d = self._masked((self.values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32).astype(float) if small else self.values.view(np.float64))

    def _span(self) -> None:
        if self.layout.inflate is not None:
            self._inflated()
            return
        before = np.cumsum(self.sizes) - self.sizes
        picked = self.data[np.repeat(self.starts - before, self.sizes) + np.arange(int(self.sizes.sum()))]
        text = self.layout.kind == STRING
        found = _texts(picked, self.sizes, pa.string() if text else pa.binary())
        if text:
            try:
                found.validate(full=True)
            except pa.ArrowInvalid:  # what isn't UTF-8 stays bytes
                self._told([x.as_py() for x in found.view(pa.binary())])
                return
            self.s = self._with_nulls(found)
        else:
            self.b = self._with_nulls(found)

    def _inflated(self) -> None:
        if self.layout.kind == STRING:
            self._told(self.values.tolist())
        else:
            self.b = pa.array(self.values.tolist(), pa.binary())

    def _told(self, content: list[bytes | None]) -> None:
        text, rest = [], []
        for x, null in zip(content, self.nulls.tolist(), strict=True):
            try:
                text.append(None if null else x.decode())
                rest.append(None)
            except UnicodeDecodeError:
                text.append(None)
                rest.append(x)
        self.s, self.b = pa.array(text, pa.string()), pa.array(rest, pa.binary())

    def _text(self, *parts) -> None:
        self.s = self._with_nulls(_spelled(list(parts), len(self.nulls)))

    def _decimal(self) -> None:
        negative, head, tail = self.values
        scale = self.layout.meta & 0xFF
        self._text(("-", negative.astype(bool)), *_digits(head, 1, 19), *([(".", True), *_digits(tail, scale, scale)] if scale else []))

    def _date(self) -> None:
        v = (self.values & np.uint64(0xFFFFFF)).astype(np.int64)
        self._text(*_digits(v >> 9, 4, 5), ("-", True), *_digits(v >> 5 & 15, 2, 2), ("-", True), *_digits(v & 31, 2, 2))

    def _apart(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign, whole part and microseconds of a big-endian value with its middle at zero."""
        size, extra = self.layout.size, (self.layout.meta + 1) // 2
        raw = self.values.byteswap() >> np.uint64(64 - 8 * size)
        value = (raw ^ np.uint64(1 << 63)).view(np.int64) if size == 8 else raw.astype(np.int64) - (1 << 8 * size - 1)
        a = np.abs(value).view(np.uint64)  # of the least number too
        rest = (a & np.uint64((1 << 8 * extra) - 1)).astype(np.int64)
        return value < 0, (a >> np.uint64(8 * extra)).astype(np.int64), rest * 10 ** (6 - 2 * extra)

    def _moment(self) -> None:
        negative, v, micros = self._apart()
        month, day, clock = v >> 22, v >> 17 & 31, v & 0x1FFFF
        date = [("-", negative), *_digits(month // 13, 4, 5), ("-", True), *_digits(month % 13, 2, 2), ("-", True), *_digits(day, 2, 2)]
        self._text(*date, (" ", True), *_digits(clock >> 12, 2, 2), (":", True), *_digits(clock >> 6 & 63, 2, 2), (":", True), *_digits(clock & 63, 2, 2), *_fraction(micros, self.layout.meta))

    def _clock(self) -> None:
        negative, v, micros = self._apart()
        self._text(("-", negative), *_digits(v >> 12, 2, 4), (":", True), *_digits(v >> 6 & 63, 2, 2), (":", True), *_digits(v & 63, 2, 2), *_fraction(micros, self.layout.meta))

    def _stamp(self) -> None:
        extra = (self.layout.meta + 1) // 2
        raw = (self.values.byteswap() >> np.uint64(64 - 8 * self.layout.size)).astype(np.int64)
        self._text(*_digits(raw >> 8 * extra, 1, 10), *_fraction((raw & (1 << 8 * extra) - 1) * 10 ** (6 - 2 * extra), self.layout.meta))

    def field(self, name: str) -> pa.Array:
        """i, d, s or b; all null if the column has none of it."""
        found = getattr(self, name)
        return pa.nulls(len(self.nulls), {"i": pa.int64(), "d": pa.float64(), "s": pa.string(), "b": pa.binary()}[name]) if found is None else found


class Rows:
    """What was read: for each row its event and its number in it, and the images; ``left`` are the events that weren't."""

    def __init__(self, event: np.ndarray, number: np.ndarray, images: list[Image | None], picked: np.ndarray, left: np.ndarray, data: np.ndarray):
        self.event, self.number, self.images, self.picked, self.left, self.data = event, number, images, picked, left, data

    def column(self, side: int, c: int) -> Column:
        return self.images[side].column(c, self.picked, self.data)

    def parts(self, most: int):
        """The rows in parts of at most ``most``."""
        for at in range(0, len(self.event), most):
            part = slice(at, at + most)
            yield Rows(self.event[part], self.number[part], self.images, self.picked[part], self.left, self.data)


def read(kind: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: C.TableMap, wanted: tuple[set[int], set[int]] | None = None) -> Rows | None:
    """The rows of events of one kind and table map; none if they are to be read one by one.

    ``data`` holds the bodies and eight bytes more. ``wanted``: the columns to keep of the images before and after; all if none.
    """
    layouts, n = plan(table), len(table.types)
    if layouts is None or len(starts) < LEAST or len(data) < 40:
        return None
    update, size = C.OPS[kind] == "UPDATE", (n + 7) // 8
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    head = 10 if kind >= 30 else 8
    at = starts + head + 1 + size * (2 if update else 1)
    ok = at <= ends
    here = np.where(ok, starts, 0)
    if kind >= 30:
        ok &= (data[here + 8] == 2) & (data[here + 9] == 0)
    full = [0xFF] * (n // 8) + [(1 << n % 8) - 1] * (n % 8 > 0)
    ok &= data[np.minimum(here + head, len(data) - 1)] == n
    for k, mask in enumerate(full * (2 if update else 1)):
        ok &= data[np.minimum(here + head + 1 + k, len(data) - 1)] & mask == mask
    sides = (0, 1) if update else (1,) if C.OPS[kind] == "INSERT" else (0,)
    every = set(range(n))
    images = [Image(layouts, every if wanted is None else wanted[side]) if side in sides else None for side in (0, 1)]
    event, number, step = [], [], 0
    active = np.flatnonzero(ok & (at < ends))
    while len(active) >= LEAST:
        fine, to = np.ones(len(active), bool), at[active]
        for side in sides:
            to, inside = images[side].read(data, eights, to, ends[active])
            fine &= inside
        event.append(active)
        number.append(np.full(len(active), step, np.int32))
        ok[active[~fine]] = False
        at[active] = to
        active, step = active[fine & (to < ends[active])], step + 1
    ok[active] = False  # the few that go on
    if not event:
        return None if not ok.any() else Rows(np.zeros(0, np.int64), np.zeros(0, np.int32), images, np.zeros(0, np.int64), np.flatnonzero(~ok), data)
    event, number = np.concatenate(event), np.concatenate(number)
    picked = np.flatnonzero(ok[event])
    for side in sides:
        images[side].close(picked, data)
    return Rows(event[picked], number[picked], images, picked, np.flatnonzero(~ok), data)


def groups(batch: pa.RecordBatch, kind: str, body: str, declared: str, known: str, usable: np.ndarray):
    """(kind, rows of the batch, starts, ends, declared map, what is known of the table) of the usable rows by these, and
    their bodies' bytes."""
    names = batch.schema.names
    content = batch.column(names.index(body)).cast(pa.large_binary())
    offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    raw = np.frombuffer(content.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if content.buffers()[2] is not None else np.zeros(0, np.uint8)
    data, offsets = np.concatenate([raw, np.zeros(8, np.uint8)]), offsets - offsets[0]
    maps = batch.column(names.index(declared)).dictionary_encode()
    which = maps.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    told = batch.column(names.index(known)).fill_null("").dictionary_encode()
    kinds = batch.column(names.index(kind)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    usable = usable & (which >= 0) & np.isin(kinds, list(C.OPS)) & content.is_valid().to_numpy(zero_copy_only=False)
    key = (which * max(len(told.dictionary), 1) + told.indices.to_numpy(zero_copy_only=False)) * 256 + kinds
    found = []
    for k in np.unique(key[usable]).tolist():
        rows = np.flatnonzero(usable & (key == k))
        m, t = divmod(k // 256, len(told.dictionary))
        found.append((k % 256, rows, offsets[rows], offsets[rows + 1], maps.dictionary[m].as_py(), told.dictionary[t].as_py() or None))
    return data, found


def pieces(batch: pa.RecordBatch, body: str, most: int = 4 << 20):
    """The batch in slices of at most about ``most`` bytes of bodies."""
    content = batch.column(batch.schema.names.index(body)).cast(pa.large_binary())
    offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Reader:
    """Reads batches of attached row events; what it leaves is told by ``left``, a flag for each row of the batch."""

    def __init__(self):
        self.tables: dict[tuple[bytes, str | None], C.TableMap] = {}
        self.left = np.zeros(0, bool)

    def table(self, declared: bytes, known: str | None = None) -> C.TableMap:
        """Parsed once; at most some thousands are kept. ``known``: names and signs of its columns as JSON."""
        found = self.tables.get((declared, known))
        if found is None:
            if len(self.tables) > 4096:
                self.tables.clear()
            found = self.tables[declared, known] = C.TableMap(declared)
            if known:
                told = json.loads(known)
                found.know(told.get("names") or [], told.get("unsigned"))
            found.shown = [n or str(i) for i, n in enumerate(found.names)]
        return found

    def groups(self, batch: pa.RecordBatch, make, wanted=None):
        """What ``make(kind, table, rows of the batch, what was read)`` yields for each group of events that could be read."""
        usable = batch.column(batch.schema.names.index("crc_ok")).fill_null(False).to_numpy(zero_copy_only=False)
        usable = usable & (batch.column(batch.schema.names.index("code")).fill_null(0).to_numpy(zero_copy_only=False) == 0)
        self.left = np.ones(batch.num_rows, bool)
        data, found = groups(batch, "type_code", "body", "map_body", "known", usable)
        for kind, rows, starts, ends, declared, known in found:
            try:
                table = self.table(declared, known)
                got = read(kind, data, starts, ends, table, None if wanted is None else wanted(table))
            except LogError:  # one of these events; it is found when they are read one by one
                continue
            if got is not None:
                self.left[rows] = False
                self.left[rows[got.left]] = True
                yield from make(kind, table, rows, got)
