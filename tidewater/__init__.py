"""Tidewater: prompt completion and training-data preparation as Spark jobs."""

from tidewater.operators.completion import CompletionError, RequestError, RetriesExhausted, complete
from tidewater.sources.endpoint import HttpTransport, OAuthTokens, TokenSource, oauth_transport
from tidewater.sources.settings import Settings

__all__ = [
    "CompletionError", "HttpTransport", "OAuthTokens", "RequestError", "RetriesExhausted", "Settings", "TokenSource",
    "complete", "oauth_transport",
]
__version__ = "0.1.0"
