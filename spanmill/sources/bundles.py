"""Model bundles: a manifest and payload files by role, on any file system that Spark reads.

A bundle is changed by writing new payloads beside the old ones and then moving
a new manifest over the old one in one step, so a reader, or a crash at any
point, finds either the old bundle or the new one whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from spanmill.operators.kernels import Kernel, compile_kernel
from spanmill.operators.nets import Net
from spanmill.sources.artifacts import ArtifactError

FORMAT = "spanmill-bundle-1"
MANIFEST = "manifest.json"
#: Bytes of a manifest and of a payload at most: payloads go to every task.
MANIFEST_BYTES = 1 << 20
PAYLOAD_BYTES = 64 << 20
THRESHOLD = 0.5


@dataclass(frozen=True)
class Head:
    """A net of a bundle with the kernel that makes its features, its labels and a threshold for each."""

    role: str
    net: Net
    kernel: Kernel
    labels: tuple[str, ...]
    thresholds: tuple[float, ...]


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    at, system, _ = _file_system(spark, path)
    return system.exists(at)


def _read(spark: SparkSession, path: str, most: int) -> bytes:
    """A file's bytes; missing and larger than ``most`` raise. The driver reads it, so executors need not see it."""
    at, system, _ = _file_system(spark, path)
    if not system.exists(at):
        raise ArtifactError(f"{path} is missing")
    if (size := system.getFileStatus(at).getLen()) > most:
        raise ArtifactError(f"{path} has {size} bytes, {most} at most are read")
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    at, system, _ = _file_system(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The manifest of a bundle, its fields checked."""
    try:
        raw = json.loads(_read(spark, f"{root}/{MANIFEST}", MANIFEST_BYTES))
    except json.JSONDecodeError as e:
        raise ArtifactError(f"the manifest isn't JSON: {e}") from None
    if not isinstance(raw, dict) or raw.get("format") != FORMAT:
        raise ArtifactError("unknown format of the manifest")
    if not isinstance(raw.get("heads"), dict) or not isinstance(raw.get("files"), list) or not raw["files"]:
        raise ArtifactError("a manifest needs heads and at least one file")
    roles = [f.get("role") for f in raw["files"]]
    if len(set(roles)) < len(roles):
        raise ArtifactError("a role stands twice")
    return raw


def _safe(path: str) -> str:
    if re.search(r"^/|^[A-Za-z]+:|(?:^|/)\.\.(?:/|\Z)|\\", path) or not path:
        raise ArtifactError(f"unsafe path {path!r}")
    return path


def load(spark: SparkSession, root: str, role: str) -> Head:
    """The head of a role: its payload is read and its size and SHA-256 checked, and its widths against kernel and labels.

    A label without a threshold has ``THRESHOLD``.
    """
    manifest = read_manifest(spark, root)
    entry = next((f for f in manifest["files"] if f.get("role") == role), None)
    about = manifest["heads"].get(role)
    if entry is None or about is None:
        raise ArtifactError(f"no payload or no head of role {role!r}")
    data = _read(spark, f"{root}/{_safe(entry['path'])}", PAYLOAD_BYTES)
    if len(data) != entry.get("bytes") or hashlib.sha256(data).hexdigest() != str(entry.get("sha256")).lower():
        raise ArtifactError(f"{entry['path']} isn't what the manifest says")
    net = Net.from_json(data.decode())
    kernel = compile_kernel(about["kernel"], about.get("pattern", "[.!?]"))
    labels = tuple(about.get("labels") or ())
    if not labels or len(set(labels)) < len(labels):
        raise ArtifactError("a head needs labels, each once")
    for what, given, own in (("feature_dim", about.get("feature_dim"), kernel.width), ("inputs of the net", net.inputs, kernel.width), ("outputs of the net", net.outputs, len(labels))):
        if given not in (None, 0, own):
            raise ArtifactError(f"{what}: {given}, wanted {own}")
    thresholds = manifest.get("thresholds", {})
    return Head(role, net, kernel, labels, tuple(float(thresholds.get(x, THRESHOLD)) for x in labels))


def upsert(spark: SparkSession, root: str, role: str, net: Net, kernel: list[dict], labels: list[str], thresholds: dict[str, float] | None = None, pattern: str = "[.!?]", name: str = "spanmill", digits: int | None = None) -> dict:
    """Put a head into a bundle, in place of the one of its role if there is one, and return the new manifest.

    The payload gets a name of its own content, then the manifest is swapped;
    payloads that no entry names any more go last. Of two writers at once the
    later swap wins.
    """
    fitted = compile_kernel(kernel, pattern)
    if net.inputs != fitted.width or net.outputs != len(labels):
        raise ArtifactError(f"a net of {net.inputs} inputs and {net.outputs} outputs for {fitted.width} features and {len(labels)} labels")
    old = read_manifest(spark, root) if _exists(spark, f"{root}/{MANIFEST}") else {"heads": {}, "files": [], "thresholds": {}}
    data = net.to_json(digits).encode()
    digest = hashlib.sha256(data).hexdigest()
    path = f"{role}-{digest[:16]}.json"
    _write(spark, f"{root}/{path}", data)
    files = [f for f in old["files"] if f["role"] != role] + [{"path": path, "role": role, "bytes": len(data), "sha256": digest}]
    heads = {**old["heads"], role: {"kernel": kernel, "pattern": pattern, "feature_dim": fitted.width, "labels": list(labels)}}
    manifest = {"format": FORMAT, "name": name, "heads": heads, "thresholds": {**old.get("thresholds", {}), **(thresholds or {})}, "files": sorted(files, key=lambda f: f["role"])}
    draft = f"{root}/.{MANIFEST}.{uuid.uuid4().hex}"
    _write(spark, draft, json.dumps(manifest, indent=1).encode())
    swap(spark, draft, f"{root}/{MANIFEST}")
    kept = {f["path"] for f in files}
    for gone in {f["path"] for f in old["files"]} - kept:
        at, system, _ = _file_system(spark, f"{root}/{_safe(gone)}")
        system.delete(at, False)
    return manifest


def swap(spark: SparkSession, source: str, target: str) -> None:
    """Move a file over another in one step."""
    at, _, hadoop = _file_system(spark, source)
    to = hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    rename = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(at, to, rename)
