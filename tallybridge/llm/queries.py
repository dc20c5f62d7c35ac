"""All registered queries of this subpackage."""

from __future__ import annotations

from . import chat, embeddings, hosts, langid, licenses, lines, merkle, mixing, packing, phrases, quality, simhash, tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
