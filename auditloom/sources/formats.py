"""Versions of the audit file, told by namespace, root and marks in the head of a file."""

from __future__ import annotations

import re

# FIXED VALUES: known namespaces, lower case without trailing slash: version and status
NAMESPACES = {
    "http://www.auditfiles.nl/xaf/3.0": ("3.0", "unverified"),
    "http://www.auditfiles.nl/xaf/3.1": ("3.1", "official"),
    "http://www.auditfiles.nl/xaf/3.2": ("3.2", "official"),
    "http://www.odb.belastingdienst.nl/belastingdienst/bcpp/1.0/structures/xmlauditfilefinancieel3.2.1": ("3.2.1", "official"),
    "http://www.odb.belastingdienst.nl/belastingdienst/bcpp/1.1/structures/xmlauditfilexaf_4.0": ("4.0", "official"),
    "http://www.odb.belastingdienst.nl/xaf/4.0": ("4.0", "documented-variant"),
    "http://www.auditfiles.nl/xaf/4.0": ("4.0", "known-bogus"),
    "http://www.auditfiles.nl/xaf/2.0": ("CLAIR2", "known-bogus"),
}
# FIXED VALUES: how far a namespace's status is trusted
TRUST = {"official": 1.0, "documented-variant": 0.9, "known-bogus": 0.7, "unverified": 0.7}
ADF_MARK = b"CLAIR1.00.00"
FOLLOWS = re.compile(rb"<!--\s*Vervolgbestand\s+(\d+)\s+van\s+(\d+)\s*-->", re.IGNORECASE)
# FIXED VALUES: versions that allow only some encodings, and these
RESTRICTED, ALLOWED = ("3.2", "3.2.1", "4.0"), ("utf-8", "iso8859-1")
NAME = re.compile(r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)")
ROOT = re.compile(r"<(?:[\w.-]+:)?(\w+)((?:\s[^>]*)?)>")


def strangers(text: str, vocabularies: dict[str, frozenset[str]]) -> dict[str, int]:
    """How many of a text's element names each version's vocabulary lacks, versions in the order that they are given."""
    names = set(NAME.findall(text))
    return {version: len(names - known) for version, known in vocabularies.items()}


def told(uri: str | None, text: str, vocabularies: dict[str, frozenset[str]]) -> tuple[str | None, float, str]:
    """(version, confidence, status of the namespace) from a known namespace, and from the vocabularies of versions if they are given."""
    version, status = NAMESPACES.get((uri or "").strip().rstrip("/").lower(), (None, "unknown" if uri else "none"))
    lacking = strangers(text, vocabularies)
    if version:
        # an official namespace stands even if another version fits better; a doubtful one gives way to one of its family
        rivals = lacking if status == "official" else {v: n for v, n in lacking.items() if (v == "CLAIR2") == (version == "CLAIR2")}
        if version in rivals and min(rivals.values()) < rivals[version]:
            return (version if status == "official" else min(rivals, key=rivals.__getitem__)), 0.6, status
        return version, TRUST[status], status
    if lacking:
        best = min(lacking, key=lacking.__getitem__)
        return best, 0.3 if lacking[best] else 0.5, status
    # without vocabularies, elements that only one generation has
    version = "4.0" if re.search("<(Commercenr|RGScode|RGSVersion)>", text) else "3.2" if "<trLine>" in text or "<auditfile" in text else None
    return version, 0.5 if version else 0.0, status


def detect(head: bytes, encoding: str, vocabularies: dict[str, frozenset[str]] | None = None) -> dict[str, str | None]:
    """family, version, namespace, status, confidence and continuation of a file's decompressed head.

    vocabularies: the element names of each version, such as those of its schema's catalogue; of versions that fit equally well the
    first given is taken.
    """
    follows = FOLLOWS.search(head)
    found: dict[str, str | None] = {"continuation": f"{int(follows[1])}/{int(follows[2])}" if follows else None, "encoding": encoding}
    if ADF_MARK in head[:64]:
        return found | {"family": "ADF", "version": "ADF", "namespace": None, "status": "none", "confidence": "1.0"}
    text = head.decode(encoding, "replace")
    root = ROOT.search(text)
    space = re.search(r"""xmlns(?::[\w.-]+)?\s*=\s*["']([^"']*)["']""", root[2]) if root else None
    uri = space[1] if space else None
    version, confidence, status = told(uri, text, vocabularies or {})
    if re.search(r"<auditfileVersion>\s*CLAIR2[^<]*<", text, re.IGNORECASE):
        version, confidence = "CLAIR2", 1.0 if status == "none" else 0.8
    family = "CLAIR2" if version == "CLAIR2" else "XAF" if version else None
    return found | {"family": family, "version": version, "namespace": uri, "status": status, "confidence": str(confidence)}


def forbidden(version: str | None, encoding: str) -> bool:
    """Whether a version doesn't allow an encoding (a name as Python has it)."""
    return version in RESTRICTED and encoding not in ALLOWED


def misnumbered(parts: list[bytes]) -> str:
    """What is wrong with the numbers that the continuations (all parts but the first) give themselves; empty if nothing."""
    wrong = []
    for place, data in enumerate(parts[1:], 2):
        said = FOLLOWS.search(data[: 1 << 16])
        if said and (int(said[1]), int(said[2])) != (place, len(parts)):
            wrong.append(f"part {place} of {len(parts)} says {int(said[1])} of {int(said[2])}")
    return "; ".join(wrong)
