"""Model references and contracts read from a model's own folder."""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import dataclass
from pathlib import Path

from spindrift.operators.embedding import Contract, HashBackend, Prompts


@dataclass(frozen=True)
class ModelRef:
    kind: str  # hub, dir or named
    name: str
    revision: str | None = None


def parse_ref(text: str) -> ModelRef:
    """``hf:owner/name[@rev]``, ``dir:path``, ``fastembed:name``, ``owner/name`` or a bare name."""
    text = text.strip()
    if not text:
        raise ValueError("no model reference")
    scheme, colon, rest = text.partition(":")
    if colon and scheme == "dir":
        return ModelRef("dir", rest)
    if colon and scheme == "fastembed":
        return ModelRef("named", rest)
    if (colon and scheme == "hf") or "/" in text:
        name, _, rev = (rest if colon and scheme == "hf" else text).partition("@")
        if name.count("/") != 1 or name[0] == "/" or name[-1] == "/":
            raise ValueError(f"{text!r} isn't of the form hf:owner/name[@revision]")
        return ModelRef("hub", name, rev or None)
    return ModelRef("named", text)


def weights_header(path: str, most: int = 100 << 20) -> dict:
    """The tensors' names and shapes of a weights file, read from its header alone."""
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        if n > most:
            raise ValueError(f"a header of {n} bytes")
        return json.loads(f.read(n))


def resolve(ref: str, lock: str | None = None) -> Contract:
    """The contract of a local model folder; its files' hash is recorded at first use and must not change."""
    r = parse_ref(ref)
    if r.kind == "named" and r.name.startswith("token-hash-"):
        return HashBackend(int(r.name.rpartition("-")[2])).contract
    if r.kind != "dir":
        raise ValueError(f"{ref} can't be fetched here; use dir:")
    folder = Path(r.name)
    read = lambda f: json.loads((folder / f).read_text()) if (folder / f).is_file() else None
    config = read("config.json") or {}
    pooling = read("1_Pooling/config.json") or {}
    override = read("spindrift_model.json") or {}
    prompts = (read("config_sentence_transformers.json") or {}).get("prompts", {})
    way = override.get("pooling") or next((v for k, v in (("pooling_mode_lasttoken", "last"), ("pooling_mode_cls_token", "cls"), ("pooling_mode_mean_tokens", "mean")) if pooling.get(k)), None)
    size = override.get("dimensions") or pooling.get("word_embedding_dimension") or config.get("hidden_size")
    if way is None or size is None:
        raise ValueError(f"{folder} doesn't say its pooling or width; add spindrift_model.json")
    query, doc = prompts.get("query", ""), prompts.get("document", "")
    if "Instruct:" in query:
        p = Prompts("instruction", query_template="Instruct: {instruction}\nQuery:{query}", default_instruction=query.split("Instruct:")[1].split("\n")[0].strip() or None)
    else:
        p = Prompts("prefixes", query=query, document=doc) if query or doc else Prompts()
    if lock:
        _locked(folder, Path(lock))
    return Contract(str(folder), int(size), True, int(override.get("max_length") or config.get("max_position_embeddings") or 512), way, p)


def artifact_hash(folder: Path) -> str:
    h = hashlib.sha256()
    for f in sorted(p for p in folder.rglob("*") if p.is_file()):
        data = f.read_bytes()
        name = f.relative_to(folder).as_posix().encode()
        h.update(struct.pack("<QQ", len(name), len(data)) + name + data)
    return h.hexdigest()


def _locked(folder: Path, lock: Path) -> None:
    known = json.loads(lock.read_text()) if lock.exists() else {}
    now = artifact_hash(folder)
    if known.setdefault(str(folder), now) != now:
        raise ValueError(f"{folder} isn't what {lock} recorded")
    lock.write_text(json.dumps(known, indent=1))


def make_backend(contract: Contract):
    """A factory for the contract's backend; only the hash backend needs no model files."""
    if contract.model.startswith("token-hash-"):
        return lambda: HashBackend(contract.dimensions)
    raise ValueError(f"no runtime for {contract.model} is installed; pass your own backend")
