"""Box arithmetic as column expressions. A box is four columns (x0, y0, x1, y1); names are given by prefix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from pagequarry.schemas import CLASSES


@dataclass(frozen=True)
class Box:
    """Four columns of a rectangle."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @staticmethod
    def xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
        return Box(x, y, x + w, y + h)

    def named(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{c}": getattr(self, c) for c in ("x0", "y0", "x1", "y1")}

    def map(self, f) -> Box:
        return Box(f(self.x0), f(self.y0), f(self.x1), f(self.y1))

    def shifted(self, dx, dy) -> Box:
        return Box(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy)

    def ordered(self) -> Box:
        """Inverted corners put right."""
        return Box(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def width(self) -> Column:
        return self.x1 - self.x0

    def height(self) -> Column:
        return self.y1 - self.y0

    def area(self) -> Column:
        b = self.ordered()
        return (b.width() * b.height()).cast("double")

    def to_xywh(self) -> tuple[Column, Column, Column, Column]:
        return self.x0, self.y0, self.width(), self.height()

    def centroid(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / F.lit(2.0), (self.y0 + self.y1) / F.lit(2.0)

    def outward(self) -> Box:
        """Whole pixels that contain the box."""
        return Box(F.floor(self.x0).cast("int"), F.floor(self.y0).cast("int"), F.ceil(self.x1).cast("int"), F.ceil(self.y1).cast("int"))

    def truncated(self) -> Box:
        return self.map(lambda c: c.cast("int"))

    def normalised(self, width: Column, height: Column) -> Box:
        return Box(self.x0 / width, self.y0 / height, self.x1 / width, self.y1 / height)

    def scaled(self, width: Column, height: Column) -> Box:
        return Box(self.x0 * width, self.y0 * height, self.x1 * width, self.y1 * height)


def intersection(a: Box, b: Box) -> Column:
    a, b = a.ordered(), b.ordered()
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return (F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)).cast("double")


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the area of b; null for an empty b."""
    return F.try_divide(intersection(a, b), b.area())


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return F.try_divide(both, a.area() + b.area() - both)


def class_name(class_id: Column) -> Column:
    name = F.lit(None).cast("string")
    for number, label in reversed(CLASSES.items()):
        name = F.when(class_id == number, label).otherwise(name)
    return name


def padded_height(h: Column, ratio: float = 1.2) -> Column:
    """Height of a region crop after white rows are added."""
    return (h * F.lit(ratio)).cast("int")


def top_padding(h: Column, ratio: float = 1.2) -> Column:
    return F.floor((padded_height(h, ratio) - h) / 2).cast("int")


def quad_corner(quad: str, i: int) -> Column:
    return F.element_at(F.col(quad), i + 1)


def line_box(quad: str) -> Box:
    """Whole-pixel box of a flat quad (x1 y1 .. x4 y4). The last corner that names a side defines it: left from x4, top from y2, right from x3, bottom from y4."""
    return Box(quad_corner(quad, 6), quad_corner(quad, 3), quad_corner(quad, 4), quad_corner(quad, 7)).outward()


def word_box(quad: str) -> Box:
    """Bounding box by the outer of each side's two corners."""
    q = [quad_corner(quad, i) for i in range(8)]
    return Box(F.least(q[0], q[6]), F.least(q[1], q[3]), F.greatest(q[2], q[4]), F.greatest(q[5], q[7]))


def to_page(box: Box, region: Box, pad_top: Column) -> Box:
    """From a padded region crop to the page; the top padding is taken off both vertical sides."""
    return Box(region.x0 + box.x0, region.y0 + box.y0 - pad_top, region.x0 + box.x1, region.y0 + box.y1 - pad_top)


def recogniser_geometry(h: Column, w: Column, height: int = 32, width: int = 256) -> dict[str, Column]:
    """How a crop is fitted to the recogniser: resized size, padding, and the width in use (0 if it fits exactly)."""
    fit_w = (F.lit(height) * w / h).cast("int")
    wide = fit_w > width
    new_h = F.when(wide, (F.lit(width * height) / fit_w).cast("int")).otherwise(F.lit(height))
    return {
        "resized_w": F.when(wide, F.lit(width)).otherwise(fit_w),
        "resized_h": new_h,
        "pad_right": F.when(wide, F.lit(0)).otherwise(F.lit(width) - fit_w),
        "pad_bottom": F.lit(height) - new_h,
        "mask": F.when(wide, F.lit(width)).when(fit_w < width, fit_w).otherwise(F.lit(0)),
    }


def rotated_crop_geometry(quad: str) -> dict[str, Column]:
    """Size of a quad's upright crop, and whether its corners run counterclockwise and the crop is turned."""
    q = [quad_corner(quad, i) for i in range(8)]
    xs, ys = q[0::2], q[1::2]
    crossed = [xs[i] * ys[j] - xs[j] * ys[i] for i, j in ((0, 1), (1, 2), (2, 3), (3, 0))]
    area = (crossed[0] + crossed[1] + crossed[2] + crossed[3]) / F.lit(2.0)
    side = lambda i, j: F.hypot(xs[i] - xs[j], ys[i] - ys[j])
    swap = area < 0
    across, down = F.greatest(side(0, 1), side(2, 3)), F.greatest(side(0, 3), side(1, 2))
    w = F.when(swap, down).otherwise(across).cast("int")
    h = F.when(swap, across).otherwise(down).cast("int")
    return {"signed_area": area, "swapped": swap, "crop_w": w, "crop_h": h, "turned": F.coalesce(F.try_divide(h.cast("double"), w.cast("double")) >= 1.5, F.lit(False))}


def slice_length(lo: Column, hi: Column, size: Column) -> Column:
    """Length of lo:hi over size elements; negative ends count from the back."""
    at = lambda c: F.greatest(F.lit(0), F.least(size, F.when(c < 0, c + size).otherwise(c)))
    return F.greatest(F.lit(0), at(hi) - at(lo)).cast("int")


def file_stem(name: Column) -> Column:
    """Text before the one dot; null if there is not exactly one."""
    return F.when(F.size(F.split(name, r"\.")) == 2, F.element_at(F.split(name, r"\."), 1))


def file_extension(name: Column) -> Column:
    return F.when(F.size(F.split(name, r"\.")) == 2, F.element_at(F.split(name, r"\."), 2))
