"""Declarative data contracts for Spark DataFrames and streams."""

from tablepact.contract import Contract, ContractError, load_contract
from tablepact.plans.validate import Validation, validate, validate_groups

__all__ = ["Contract", "ContractError", "Validation", "load_contract", "validate", "validate_groups"]
