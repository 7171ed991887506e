"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from .conversations import OP11_SQL, op11_conversations
from .decontaminate import OP7_SQL, op7_decontamination
from .importance import OP13_SQL, op13_importance
from .language_model import op10_language_model
from .minhash import OP12_SQL, op12_minhash
from .mixing import OP2_SQL, op2_mixing
from .ngram_join import OP3_SQL, op3_ngram_join
from .pipeline import run as run_pipeline
from .prefix_tokens import op8_prefix_tokens
from .quality_mil import op6_quality_classifier
from .quality_rules import op1_quality_rules
from .scratch import prepare
from .token_files import op4_token_files
from .toxicity import op5_toxicity
from .warc import OP9_SQL, op9_warc


def pipeline(spark, sf_dir: str):
    return run_pipeline(spark, sf_dir)


def _prepared(f):
    @wraps(f)
    def run(spark, sf_dir: str):
        prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    ops = (
        op1_quality_rules, op2_mixing, op3_ngram_join, op4_token_files, op5_toxicity, op6_quality_classifier, op7_decontamination,
        op8_prefix_tokens, op9_warc, op10_language_model, op11_conversations, op12_minhash, op13_importance, pipeline,
    )
    return {f.__name__: _prepared(f) for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op3_ngram_join": OP3_SQL, "op7_decontamination": OP7_SQL, "op9_warc": OP9_SQL, "op11_conversations": OP11_SQL, "op12_minhash": OP12_SQL, "op13_importance": OP13_SQL}
