"""Forms in which packs, vectors and names are written: JSON and binary packs, compressed text, float bytes."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the binary form: its head, and the numbers of kinds, provenances, edge types and states; 0 is none of them.
HEAD, VERSION = b"GCB1", 1
KINDS = "function type method interface var const resource table class selector field route_handler external file package service env_var process".split()
PROVENANCES = "ast_inferred ast_resolved lsp_resolved otel_trace scip_resolved runtime_observed structural".split()
EDGE_TYPES = (
    "calls imports implements references handles_route depends_on deploys exposes configures extends overrides decorates throws owned_by "
    "authored_by tests runtime_calls runtime_rpc runtime_produces runtime_consumes contains member_of documents consumes_endpoint "
    "implements_rpc consumes_rpc gated_by_flag deployed_by tested_by publishes subscribes connects_to similar_to co_tested_with "
    "type_hint_of accesses_field reads_env executes_process"
).split()
STATES = ("unchanged", "added", "removed")
PARTS = ("blast_radius", "confidence", "recency", "distance")


def _number(names, name: str) -> int:
    return names.index(name) + 1 if name in names else 0


def _name(names, number: int) -> str:
    return names[number - 1] if 0 < number <= len(names) else f"unknown_{number}"


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _text(x: str) -> bytes:
    raw = x.encode()
    return _varint(len(raw)) + raw


def to_binary(pack: dict) -> bytes:
    """A pack (tool, tokens_used, token_budget, symbols, edges) in bytes; edges name symbols by their places, and an end
    that is no symbol of the pack is refused."""
    out = [HEAD, bytes([VERSION]), _text(pack["tool"]), *map(_varint, (pack["tokens_used"], pack["token_budget"], len(pack["symbols"]), len(pack.get("edges", ()))))]
    place = {s["qualified_name"]: k for k, s in enumerate(pack["symbols"])}
    for s in pack["symbols"]:
        out += [_text(s["qualified_name"]), bytes([_number(KINDS, s["kind"])]), struct.pack("<f", s["score"]), bytes([_number(PROVENANCES, s.get("provenance", "")), min(255, s.get("distance", 0))]), _text(s.get("signature", ""))]
        out.append(struct.pack("<4f", *(s.get("components", {}).get(p, 0.0) for p in PARTS)))
    for e in pack.get("edges", ()):
        state = e.get("status", "unchanged")
        out += [_varint(place[e["source"]]), _varint(place[e["target"]]), bytes([_number(EDGE_TYPES, e["edge_type"]), STATES.index(state)])]
    return b"".join(out)


def from_binary(data: bytes) -> dict:
    if data[:4] != HEAD or data[4:5] != bytes([VERSION]):
        raise ValueError("not a pack of this version")
    at = 5

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the pack ends early")
        at += n
        return data[at - n : at]

    def varint() -> int:
        n = shift = 0
        while True:
            b = take(1)[0]
            n, shift = n | (b & 0x7F) << shift, shift + 7
            if b < 0x80:
                return n

    pack: dict = {"tool": take(varint()).decode(), "tokens_used": varint(), "token_budget": varint()}
    n_symbols, n_edges = varint(), varint()
    pack["symbols"], pack["edges"] = [], []
    for _ in range(n_symbols):
        s = {"qualified_name": take(varint()).decode(), "kind": _name(KINDS, take(1)[0]), "score": struct.unpack("<f", take(4))[0], "provenance": _name(PROVENANCES, take(1)[0]), "distance": take(1)[0], "signature": take(varint()).decode()}
        s["components"] = dict(zip(PARTS, struct.unpack("<4f", take(16)), strict=True))
        pack["symbols"].append(s)
    for _ in range(n_edges):
        a, b = varint(), varint()
        kind, state = take(2)
        pack["edges"].append({"source": pack["symbols"][a]["qualified_name"], "target": pack["symbols"][b]["qualified_name"], "edge_type": _name(EDGE_TYPES, kind), "status": STATES[state]})
    return pack


@dataclass
class Codec:
    name: str
    encode: Callable[[dict], bytes]
    decode: Callable[[bytes], dict]


_codecs: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    if codec.name in _codecs:
        raise ValueError(f"{codec.name} is registered already")
    _codecs[codec.name] = codec


def get(name: str) -> Codec:
    if name not in _codecs:
        raise ValueError(f"unknown codec {name}; one of {', '.join(names())}")
    return _codecs[name]


def names() -> list[str]:
    return sorted(_codecs)


register(Codec("json", lambda p: json.dumps(p, ensure_ascii=False, sort_keys=True).encode(), json.loads))
register(Codec("gcb", to_binary, from_binary))


def squeeze(text: str) -> str:
    return base64.b64encode(zlib.compress(text.encode())).decode()


def unsqueeze(text: str) -> str:
    return zlib.decompress(base64.b64decode(text)).decode()


def _floats(col: pa.Array) -> pa.Array:
    """Little-endian float32 bytes as lists; null for null, ValueError for a torn number."""
    return pa.array([None if x is None else np.frombuffer(x, "<f4").tolist() for x in col.to_pylist()], pa.list_(pa.float32()))


def _bytes(col: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in col.to_pylist()], pa.binary())


def floats_of(column: Column) -> Column:
    return F.arrow_udf(_floats, "array<float>", F.ArrowUDFType.SCALAR)(column)


def bytes_of(column: Column) -> Column:
    return F.arrow_udf(_bytes, "binary", F.ArrowUDFType.SCALAR)(column)


def external_url(path: Column, separator: str = "/", stdlib: tuple[str, ...] = (), relative: str = r"^\.") -> Column:
    """Where an import leads: nowhere if empty or relative, `stdlib` by its first part, else `external://` and that part."""
    top = F.substring_index(path, separator, 1)
    top = F.when(top == "", path).otherwise(top)
    known = top.isin(*stdlib) if stdlib else F.lit(False)
    return F.when((path == "") | path.rlike(relative), "").when(known, "stdlib").otherwise(F.concat(F.lit("external://"), top))


def embed_text(doc: Column, kind: Column, qualified: Column, signature: Column) -> Column:
    """What stands for a symbol before a text model: its doc, kind in words, split name, package and signature."""
    last = F.substring_index(qualified, "/", -1)
    split = qualified.contains("/") & last.contains(".")
    package = F.when(split, F.substring_index(last, ".", 1)).otherwise("")
    name = F.when(split, F.regexp_replace(last, r"^[^.]*\.", "")).otherwise(qualified)
    words = F.trim(F.regexp_replace(F.regexp_replace(name, "[._]+", " "), "(?<=[a-z])(?=[A-Z])", " "))
    said = {"method": "method on a type", "type": "type definition", "interface": "interface contract", "const": "constant value", "var": "variable"}
    kind_words = kind
    for k, v in said.items():
        kind_words = F.when(kind == k, v).otherwise(kind_words)
    bare = F.regexp_replace(signature, "^func ", "")
    sig = F.when(F.instr(bare, "(") > 1, F.regexp_replace(bare, r"^[^(]*", "")).otherwise(bare)
    parts = [F.nullif(doc, F.lit("")), kind_words, words, F.when(package != "", F.concat(F.lit("in package "), package)), F.when((sig != "") & (sig != "()"), F.concat(F.lit("with signature "), sig))]
    return F.concat_ws(" ", *parts)
