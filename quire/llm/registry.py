"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import decontam, warc
from .decontam import op10_decontamination
from .line_dedup import op6_line_dedup
from .media import op1_media
from .pieces import op8_pieces
from .pii import op2_pii
from .token_store import op4_token_store
from .toxicity import op3_toxicity
from .secrets import op7_secrets
from .simhash import op9_simhash
from .warc import op5_warc

QUERIES = {"op1_media": op1_media, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_token_store": op4_token_store, "op5_warc": op5_warc, "op6_line_dedup": op6_line_dedup, "op7_secrets": op7_secrets, "op8_pieces": op8_pieces, "op9_simhash": op9_simhash, "op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {"op5_warc": warc.ORACLE, "op10_decontamination": decontam.ORACLE}
