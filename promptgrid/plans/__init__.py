"""The six pipelines."""

from promptgrid.plans.chat import chat_rows
from promptgrid.plans.classification import classification_rows
from promptgrid.plans.generic import generic_rows
from promptgrid.plans.mcq import mcq_rows
from promptgrid.plans.preference import preference_rows
from promptgrid.plans.raw import raw_rows
from promptgrid.plans.run import Outcome, run

__all__ = ["Outcome", "chat_rows", "classification_rows", "generic_rows", "mcq_rows", "preference_rows", "raw_rows", "run"]
