"""Queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from lectern.llm import licenses, linededup, warc
from lectern.llm.bpe import op4_bpe_chunks
from lectern.llm.jaccard import op10_jaccard_join
from lectern.llm.langid import op9_language_id
from lectern.llm.licenses import op8_license_scan
from lectern.llm.linededup import op5_line_dedup
from lectern.llm.media import op1_media_sequences
from lectern.llm.mixing import op7_mix_sources
from lectern.llm.quality import op6_quality_rules
from lectern.llm.sharding import op3_hilbert_shards
from lectern.llm.warc import op2_warc_roundtrip

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_sequences, op2_warc_roundtrip, op3_hilbert_shards, op4_bpe_chunks, op5_line_dedup, op6_quality_rules,
        op7_mix_sources, op8_license_scan, op9_language_id, op10_jaccard_join,
    )
}
ORACLE_SQL = {"op2_warc_roundtrip": warc.ORACLE_SQL, "op5_line_dedup": linededup.ORACLE_SQL, "op8_license_scan": licenses.ORACLE_SQL}
