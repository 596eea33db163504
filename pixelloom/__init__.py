"""Image-origin forensics and training-data operators on PySpark; the names below are loaded as they are used."""

from importlib import import_module

#: Where each public name lives.
_PLACES = {
    "Options": "sources.tables", "load_options": "sources.tables", "read_images": "sources.images", "extract": "operators.features", "unified": "operators.extractor",
    "combinations": "operators.extractor", "run_combinations": "operators.extractor", "infer_pair": "operators.extractor", "analyse": "operators.wavelet", "crop_select": "operators.wavelet",
    "Trained": "operators.ml", "train": "operators.ml", "final_model": "operators.ml", "cross_validate": "operators.ml", "load": "operators.ml", "importances": "operators.ml",
    "register": "operators.learned", "get_session": "session", "extract_stream": "streaming", "score_stream": "streaming",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)


def __dir__() -> list[str]:
    return __all__
