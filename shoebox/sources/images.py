"""Signals of decoded images: perceptual hash, aesthetic score, and a pluggable encoder.

Decoding is Spark's ``image`` source (the JVM's ImageIO) for files, or any table with (height, width,
nChannels, data) rows; everything after is NumPy over Arrow batches, one image at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.plans.tables import Scratch
from shoebox.sources.files import SCAN_LIMIT, _system, marker_preview, preview_path

#: Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


#: Suffixes whose bytes are decoded as they are; others through their embedded preview.
DIRECT = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".bmp")


def decode(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, height, width, nChannels, data) of image files; undecodable ones are left out, and names
    that begin with ``_`` or ``.`` aren't seen by the source."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(paths)
    return rows.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


#: Of those, suffixes that the JVM's reader lacks; Pillow makes PNGs of them where it is installed.
OTHERS = (".webp",)


def as_png(data: bytes) -> bytes:
    """``data`` as a PNG, or as it is without Pillow."""
    try:
        from PIL import Image
    except ImportError:
        return data
    out = io.BytesIO()
    Image.open(io.BytesIO(data)).convert("RGB").save(out, "PNG")
    return out.getvalue()


def load(spark: SparkSession, files: DataFrame, cache: str, root: str = "") -> DataFrame:
    """(path, height, width, nChannels, data, error) of every file of ``files`` (path): its own bytes where they are
    directly decodable, else its embedded preview. Both go to ``cache``, a folder that all executors reach, under a
    digest of the path, so no names collide and none is hidden. A file without a usable image has an error."""

    def put(batches):
        system, _ = _system(root) if root else (fs.LocalFileSystem(), "")
        out, base = _system(cache)
        out.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for path in batch.column("path").to_pylist():
                name = preview_path(path, base)
                try:
                    whole = path.lower().endswith(DIRECT)
                    with system.open_input_stream(path) as f:
                        data = f.read() if whole else marker_preview(f.read(SCAN_LIMIT))
                    if data and path.lower().endswith(OTHERS):
                        data = as_png(data)
                    if data:
                        with out.open_output_stream(name) as f:
                            f.write(data)
                    names.append(name.rsplit("/", 1)[-1] if data else None)
                except OSError:
                    names.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.string())], ["path", "name"])

    placed = Scratch(spark, "previews").write(files.select("path").mapInArrow(put, "path string, name string"))
    if placed.where("name is not null").isEmpty():
        images = spark.createDataFrame([], "name string, height int, width int, nChannels int, data binary")
    else:
        images = decode(spark, cache).withColumn("name", F.regexp_extract("path", r"[^/]*\z", 0)).drop("path")
    error = F.when(F.col("height").isNull(), "no decodable source and no embedded preview")
    return placed.join(images, "name", "left").select("path", "height", "width", "nChannels", "data", error.alias("error"))


def to_rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Red, green, blue from the BGR(A) or grey bytes of the image source."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2)
    return x[:, :, 2::-1] if channels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)


def _resample(x: np.ndarray, size: int) -> np.ndarray:
    """Triangle-filtered samples along the first axis, widened when shrinking."""
    n = x.shape[0]
    scale = n / size
    reach = max(1.0, scale)
    centre = (np.arange(size) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / reach)
    return (w / w.sum(axis=1, keepdims=True)) @ x


def phash(rgb: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64-bit hash: low frequencies of a cosine transform of the grey image against their median,
    row by row, first bit highest."""
    n = size * factor
    grey = np.round(_resample(_resample(rgb @ LUMA, n).T, n).T)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ grey @ basis.T)[:size, :size]
    return int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)


def aesthetic(rgb: np.ndarray, sharpness: bool = False) -> float:
    """0 to 10 from brightness, colour, contrast and, if asked for, the deviation of a Laplacian."""
    x = rgb.reshape(-1, 3).astype(np.float32)
    if not len(x):
        return 0.0
    luma = x @ LUMA
    bright = max(0.0, 1 - 2 * abs(float(x.mean(axis=0).mean()) / 255 - 0.45))
    colour = min(1.0, float(np.abs(x - luma[:, None]).mean()) / 255 / 0.35)
    contrast = min(1.0, float(luma.std()) / 255 / 0.25)
    sharp = 0.0
    if sharpness and min(rgb.shape[:2]) > 2:
        g = (rgb @ LUMA).astype(np.float32)
        lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
        sharp = min(1.0, float(lap.std()) / 255 / 20)
    return round(min(10.0, max(0.0, 10 * (0.2 * bright + 0.2 * colour + 0.25 * contrast + 0.35 * sharp))), 2)


def mean_encoder() -> Callable[[list[np.ndarray]], np.ndarray]:
    """An encoder that needs no weights: 8 x 8 mean colours. A real one has the same shape: a function
    without arguments that loads the model once for each worker and returns images -> matrix."""
    return lambda images: np.array([_resample(_resample(x.astype(float), 8).swapaxes(0, 1), 8).ravel() / 255 if x.ndim == 2 else np.stack([_resample(_resample(x[:, :, c].astype(float), 8).T, 8).T for c in range(3)], axis=2).ravel() / 255 for x in images])


# Names of the encoder's weights in the order they are tried, its usual input size, the place of its summary
# token, and the colour statistics of its training images.
ENCODERS = ("vit_small_patch14_dinov2.lvd142m", "vit_small_patch16_in21k")
INPUT_SIZE, SUMMARY = (518, 518), 0
COLOUR_MEAN, COLOUR_DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def best_device(asked: str | None = None) -> str:
    """The device asked for, else mps or cuda where there is one, else cpu."""
    if asked:
        return asked
    try:
        import torch
    except ImportError:
        return "cpu"
    return "mps" if torch.backends.mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"


def torch_model(name: str, device: str):
    """A pretrained vision transformer as an object with ``features`` (images x channels x height x width -> images x
    tokens x numbers) and the ``img_size`` that its patches want, if it tells."""
    import timm
    import torch

    model = timm.create_model(name, pretrained=True).eval().to(device)

    class Loaded:
        img_size = getattr(getattr(model, "patch_embed", None), "img_size", None)

        @staticmethod
        def features(x: np.ndarray) -> np.ndarray:
            with torch.no_grad():
                return model.forward_features(torch.from_numpy(x.astype(np.float32)).to(device)).cpu().numpy()

    return Loaded


def load_first(names: tuple[str, ...], load: Callable, device: str):
    """The first model that loads."""
    failed = []
    for name in names:
        try:
            return load(name, device)
        except Exception as x:  # the next name may load
            failed.append(f"{name}: {x!r}")
    raise RuntimeError("no encoder could be loaded; " + "; ".join(failed))


def input_size(model) -> tuple[int, int]:
    """Height and width that a model asks for, or the usual ones."""
    asked = getattr(model, "img_size", None)
    if not asked:
        return INPUT_SIZE
    height, width = (asked, asked) if isinstance(asked, int) else asked
    return int(height), int(width)


def vit_encoder(names: tuple[str, ...] = ENCODERS, load: Callable = torch_model, size: tuple[int, int] | None = None, device: str | None = None) -> Callable:
    """An ``encoder`` for ``signals``: loads the first of ``names`` once for each worker, resizes images to what the model
    asks for (or ``size``), and returns its summary token, divided by its length where that is above one."""

    def encoder():
        model = load_first(names, load, best_device(device))
        height, width = size or input_size(model)

        def encode(images: list[np.ndarray]) -> np.ndarray:
            def prepared(x):
                grown = np.stack([_resample(_resample(x[:, :, c].astype(float), height).T, width).T for c in range(3)], axis=2)
                return ((grown / 255 - COLOUR_MEAN) / COLOUR_DEVIATION).transpose(2, 0, 1)

            v = np.asarray(model.features(np.stack([prepared(x) for x in images])))[:, SUMMARY, :]
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)

        return encode

    return encoder


def signals(images: DataFrame, encoder: Callable[[], Callable] | None = mean_encoder, batch_size: int = 32, sharpness: bool = False) -> DataFrame:
    """(path, p_hash, aesthetic_score, dinov2_vector, error) of decoded rows. An image that fails is a row
    with an error. Vectors are divided by their length."""

    def run(batches):
        encode = encoder() if encoder else None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                hashes, scores, errors, good = [], [], [], []
                for r in part.select(["height", "width", "nChannels", "data"]).to_pylist():
                    try:
                        if r["data"] is None:
                            raise OSError("no decodable image")
                        rgb = to_rgb(r["height"], r["width"], r["nChannels"], r["data"])
                        h = phash(rgb)
                        hashes.append(h - (1 << 64) if h >> 63 else h)
                        scores.append(aesthetic(rgb, sharpness))
                        errors.append(None)
                        good.append(rgb)
                    except Exception as x:  # isolated per image
                        hashes.append(None)
                        scores.append(None)
                        errors.append(str(x)[:500])
                vectors = [None] * part.num_rows
                if encode and good:
                    v = np.asarray(encode(good), float)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    for i, row in zip([i for i, e in enumerate(errors) if e is None], v):
                        vectors[i] = row.tolist()
                arrays = [part.column("path"), pa.array(hashes, pa.int64()), pa.array(scores, pa.float64()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "p_hash", "aesthetic_score", "dinov2_vector", "error"])

    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(run, "path string, p_hash long, aesthetic_score double, dinov2_vector array<double>, error string")


def stats(results: DataFrame) -> DataFrame:
    """One row: processed, ok, failed."""
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
