"""Byte columns as MPEG transport streams.

A payload is cut into access units; each becomes a packetised elementary stream (PES) packet with a presentation
time, cut again into transport packets of 188 bytes beside a program association table (PAT) and a program map
table (PMT). Reading parses the tables, checks their CRC and each stream's continuity counters, reassembles the
elementary packets and lists timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 13818-1
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # PES packets with private data; private stream 1
CLOCK = 90_000

UNIT = 576  # samples of a frame
FRAMES = 8  # frames of an access unit
RATE = 48_000  # samples a second
RANDOM_ACCESS = 4  # every so many access units
STEP = CLOCK * UNIT * FRAMES // RATE


@cache
def _crc_table() -> tuple[int, ...]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return tuple(table)


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (n := len(body) + 9) >> 8, n & 255, extension >> 8, extension & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@cache
def _tables() -> np.ndarray:
    pat = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    packets = np.full((2, PACKET), 255, np.uint8)
    for row, pid, section in ((packets[0], PAT_PID, pat), (packets[1], PMT_PID, pmt)):
        head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
        row[: len(head)] = np.frombuffer(head, np.uint8)
    return packets


def _stamp(t: int, mark: int) -> list[int]:
    return [mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1]


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload of whole frames; at least one access unit."""
    packets, counter = [_tables()], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT * FRAMES)):
        unit = payload[at : at + UNIT * FRAMES]
        time, random = k * STEP, k % RANDOM_ACCESS == 0
        pes = bytes([0, 0, 1, STREAM_ID, (n := len(unit) + 8) >> 8, n & 255, 0x84, 0x80, 5, *_stamp(time & (1 << 33) - 1, 2)]) + unit
        # the first packet's adaptation field holds the random-access flag and the program clock
        base = time & (1 << 33) - 1
        first = bytes([7, 0x50 if random else 0x10, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
        room = PACKET - 4
        lead = room - len(first)
        many = 1 + -(-max(0, len(pes) - lead) // room)
        block = np.full((many, PACKET), 255, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | ((counter + np.arange(many)) & 15)
        counter += many
        short = lead + (many - 1) * room - len(pes)  # bytes of stuffing in the last packet
        if many == 1:
            first = bytes([first[0] + short]) + first[1:] + b"\xff" * short
        block[0, 3] |= 0x20
        block[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
        data = np.frombuffer(pes, np.uint8)
        if many == 1:
            block[0, 4 + len(first) :] = data
        else:
            block[0, 4 + len(first) :] = data[:lead]
            whole = many - 2
            block[1 : 1 + whole, 4:] = data[lead : lead + whole * room].reshape(whole, room)
            if short:
                block[-1, 3] |= 0x20
                block[-1, 4] = short - 1
                if short > 1:
                    block[-1, 5] = 0
            block[-1, 4 + short :] = data[lead + whole * room :]
        packets.append(block)
    return np.concatenate(packets).tobytes()


# Fixed values of ISO/IEC 13818-1: stream ids whose elementary packets have no further header, and the one of padding
PLAIN_IDS, PADDING_ID = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}, 0xBE


def _sections(p: np.ndarray, own: np.ndarray, offset: np.ndarray) -> list[bytes]:
    """The whole table sections in one PID's packets, each once, in order; a section may span packets and share them."""
    out, held = [], None

    def cut(held: bytes) -> bytes:
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                return held
            if crc32_mpeg(held[:size]):
                raise ValueError("damaged table")
            if held[:size] not in out:
                out.append(held[:size])
            held = held[size:]
        return b"" if held[:1] == b"\xff" else held

    for k in own.tolist():
        data = p[k, offset[k] :].tobytes()
        if p[k, 1] & 0x40:
            lead, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if held:
                cut(held + lead)
            held = cut(data)
        elif held is not None:
            held = cut(held + data)
    if held:
        raise ValueError("damaged table")
    return out


def _stamp_read(h: list[int]) -> int:
    return (h[0] >> 1 & 7) << 30 | h[1] << 22 | h[2] >> 1 << 15 | h[3] << 7 | h[4] >> 1


def demux(media: bytes) -> dict:
    """What a transport stream holds: payload, programs, streams, discontinuities, times, random-access points.

    All of a PAT's and PMTs' sections are read, whether repeated, spread over packets or added later. Packets sent twice
    count once; a counter may jump where its packet says so. An elementary packet without a length, as video may have,
    ends before the next. Times (presentation and decoding, the first where there is no other) and random-access points
    (offsets in a stream's payload) have their stream beside them; the payload is that of all streams, one after another.
    Raises ValueError where sync bytes, table checksums or elementary packets are damaged.
    """
    if len(media) % PACKET or not media:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("damaged packets")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts, control, counter = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    offset = 4 + np.where(control & 2, 1 + p[:, 4].astype(np.int32), 0)
    flags = np.where((control & 2 > 0) & (p[:, 4] > 0), p[:, 5], 0)
    if (offset > PACKET).any():
        raise ValueError("damaged packets")
    gaps = 0

    def packets(of: int) -> np.ndarray:
        """A PID's packets with payload, without those sent twice; counts the jumps of its counter."""
        nonlocal gaps
        own = np.flatnonzero((pid == of) & (control & 1 > 0))
        if len(own) > 1:
            step = (counter[own][1:] - counter[own][:-1]) & 15
            twice = (step == 0) & (p[own[1:], 4:] == p[own[:-1], 4:]).all(axis=1)
            gaps += int(((step != 1) & ~twice & (flags[own[1:]] & 0x80 == 0)).sum())
            own = own[np.append(True, ~twice)]
        return own

    pat = _sections(p, packets(PAT_PID), offset)
    if not pat:
        raise ValueError("no program association table")
    programs = {s[i] << 8 | s[i + 1]: (s[i + 2] & 31) << 8 | s[i + 3] for s in pat if s[0] == 0 for i in range(8, len(s) - 4, 4)}
    programs.pop(0, None)  # the network's
    streams = {}
    for of in dict.fromkeys(programs.values()):
        for pmt in _sections(p, packets(of), offset):
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            while pmt[0] == 2 and at < len(pmt) - 4:
                streams[(pmt[at + 1] & 31) << 8 | pmt[at + 2]] = pmt[at]
                at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    payload, times, decode, time_streams, random, random_streams = [], [], [], [], [], []
    for of in streams:
        own = packets(of)
        body = np.arange(PACKET)[None, :] >= offset[own][:, None]
        data, size = p[own][body], body.sum(axis=1)
        ends = np.cumsum(size)
        heads = np.flatnonzero(starts[own])
        edges = np.append((ends - size)[heads], ends[-1] if len(ends) else 0)
        flagged = flags[own[heads]] & 0x40 > 0
        done = 0
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            h = data[a : a + 19].tolist()
            if len(h) < 6 or h[:3] != [0, 0, 1]:
                raise ValueError("damaged elementary packet")
            length, plain = h[4] << 8 | h[5], h[3] in PLAIN_IDS
            begin = a + 6 if plain else a + 9 + (h[8] if len(h) > 8 else PACKET)
            if (length and length + 6 != b - a) or begin > b:
                raise ValueError("damaged elementary packet")
            if not plain and h[7] & 0x80:
                times.append(_stamp_read(h[9:14]))
                decode.append(_stamp_read(h[14:19]) if h[7] & 0x40 else times[-1])
                time_streams.append(of)
            if flagged[k]:
                random.append(done)
                random_streams.append(of)
            if h[3] != PADDING_ID:
                payload.append(data[begin:b])
                done += b - begin
    return {"payload": np.concatenate(payload).tobytes() if payload else b"", "programs": programs, "streams": streams, "discontinuities": gaps, "times": times, "decode_times": decode, "time_streams": time_streams, "random_access": random, "random_streams": random_streams, "packets": len(p)}


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length and its bytes with bytes 255 up to a positive multiple of a frame."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text stored whole as a transport stream; null texts as empty ones.

    An empty text is one frame of padding. Repeated rows are stored each; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                both = [padded(t if isinstance(t, str) else None) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [n for n, _ in both], "media": [mux(b) for _, b in both]})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(stored, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "payload binary, programs int, streams int, packets long, discontinuities long, times array<long>, decode_times array<long>, time_streams array<int>, random_access array<long>, random_streams array<int>, mean double, rms double"


def read_back(media: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every column of `media` with what its stream holds: payload, tables, counters, times, random-access points, and the
    mean and root mean square of the samples. A null medium or a damaged one has `error`, and null in all other columns."""

    lists = ["times", "decode_times", "time_streams", "random_access", "random_streams"]
    names = ["payload", "programs", "streams", "packets", "discontinuities", *lists, "mean", "rms", "payload_bytes", "payload_sha256", "tail_crc32", "error"]

    def one(stream: bytes | None) -> tuple:
        try:
            if stream is None:
                raise ValueError("no medium")
            x = demux(stream)
        except (ValueError, IndexError) as e:  # an index beyond a cut table or header
            return (*(None,) * (len(names) - 1), str(e) or "damaged")
        samples = np.bincount(np.frombuffer(x["payload"], np.uint8), minlength=256)
        level, n = np.arange(256), max(1, len(x["payload"]))
        return (x["payload"] if with_payload else None, len(x["programs"]), len(x["streams"]), x["packets"], x["discontinuities"], *(x[k] for k in lists), float((samples * level).sum() / n), float(np.sqrt((samples * level**2).sum() / n)), len(x["payload"]), hashlib.sha256(x["payload"]).hexdigest(), zlib.crc32(x["payload"][-32:]), None)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500].reset_index(drop=True)
                found = pd.DataFrame([one(m) for m in part["media"]], columns=names, dtype="object")
                yield pd.concat([part, found], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInPandas(read, f"{own}, {FEATURES}, payload_bytes long, payload_sha256 string, tail_crc32 long, error string")


def op3_transport_stream(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = read_back(store(docs), with_payload=False)
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in {
        "programs": F.col("programs").cast("string"), "streams": F.col("streams").cast("string"), "packets": F.col("packets").cast("string"),
        "gaps": F.col("discontinuities").cast("string"), "units": F.size("times").cast("string"), "last": F.coalesce(F.element_at("times", -1), F.lit(0)).cast("string"),
        "random": F.concat_ws("/", F.transform("random_access", lambda v: v.cast("string"))),
        "mean": F.format_number("mean", 4), "rms": F.format_number("rms", 4)}.items()))
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.col("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "times", "random_access")
