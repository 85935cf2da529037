"""The corpus queries and, where SQL can say it, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_urls as op1
from . import op2_minhash as op2
from . import op3_license as op3
from . import op4_media as op4
from . import op5_quality as op5
from . import op6_seeds as op6
from . import op7_mix as op7
from . import op8_warc as op8
from . import op9_chat as op9
from . import op10_lines as op10
from . import op11_phrases as op11
from . import op12_bpe as op12
from . import op13_audit as op13


def queries() -> dict:
    return {
        "op1_urls": op1.op1_urls, "op2_minhash": op2.op2_minhash, "op3_license": op3.op3_license, "op4_media": op4.op4_media, "op5_quality": op5.op5_quality,
        "op6_seeds": op6.op6_seeds, "op7_mix": op7.op7_mix, "op8_warc": op8.op8_warc, "op9_chat": op9.op9_chat, "op10_lines": op10.op10_lines,
        "op11_phrases": op11.op11_phrases, "op12_bpe": op12.op12_bpe, "op13_audit": op13.op13_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_minhash": op2.OP2_SQL, "op8_warc": op8.OP8_SQL, "op9_chat": op9.OP9_SQL, "op11_phrases": op11.OP11_SQL, "op13_audit": op13.OP13_SQL}
