"""Language model providers."""

from promptgrid.providers.adapters import AnthropicProvider, GeminiProvider, MistralProvider, OllamaProvider, OpenAIProvider, OpenRouterProvider
from promptgrid.providers.base import Provider, RateLimitError
from promptgrid.providers.stub import ScriptedProvider, StubProvider

__all__ = ["AnthropicProvider", "GeminiProvider", "MistralProvider", "OllamaProvider", "OpenAIProvider", "OpenRouterProvider", "Provider", "RateLimitError", "ScriptedProvider", "StubProvider"]
