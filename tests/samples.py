from glintsieve.operators.samples import NEGATIVES, positives, secret

__all__ = ["NEGATIVES", "positives", "secret"]
