"""Errors that loaders, builders and configuration raise."""


class ModelError(Exception):
    """Whatever is wrong with a model, its files or its settings."""


class ArpaError(ModelError):
    """Text that isn't a well-formed ARPA model."""


class FormatError(ModelError):
    """A stored model of another kind than asked for, or none at all."""


class VersionError(ModelError):
    """A stored model written by another version of the layout."""


class ConfigError(ModelError):
    """A setting outside of what is supported."""


class DiscountError(ModelError):
    """Counts from which no discounts can be computed."""


class VocabularyError(ModelError):
    """A word or marker that the vocabulary must have and lacks."""


class PositiveProbabilityError(ArpaError):
    """A log probability above 0 where the policy is to raise."""
