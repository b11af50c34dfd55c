"""Exceptions of the library. Structural problems raise when a plan is built; problems that only
data can show surface through ``raise_error`` in the plan."""


class VoxelError(Exception):
    """Base of all errors here."""


class NonParallelPlanesError(VoxelError):
    """A plane lies off the axis of its grid."""


class NonOrthogonalBasisError(VoxelError):
    """Row and column direction are not orthogonal."""


class ResourceLimitError(VoxelError):
    """More voxels than the budget allows."""


class IndeterminateVolumeError(VoxelError):
    """A grid of one plane has no thickness."""


class IndeterminateCentroidError(VoxelError):
    """An empty mask has no centroid."""


class GridMismatchError(VoxelError):
    """Two inputs don't share a grid."""


class FrameOfReferenceMismatchError(VoxelError):
    """Both frames of reference are known and differ."""


class NotImplementedMethodError(VoxelError, NotImplementedError):
    """A method that is named but not offered."""


class XorHomogeneityError(VoxelError):
    """XOR contours are mixed with other types."""


class InconsistentSeriesError(VoxelError):
    """Instances of a series differ in geometry."""


class MalformedContourError(VoxelError):
    """A contour has too few points or a coordinate that is not finite."""


class AmbiguousRoiNameError(VoxelError):
    """More than one ROI has this name."""


class NotStructureSetError(VoxelError):
    """The dataset is not a structure set."""


class NotSegmentationError(VoxelError):
    """The dataset is not a segmentation."""


class MalformedSegmentationError(VoxelError):
    """A segmentation lacks a part or contradicts itself."""


class UnsupportedSegmentationTypeError(VoxelError):
    """Neither BINARY nor FRACTIONAL nor LABELMAP."""


class LabelmapOverlapError(VoxelError):
    """Two segments of a label map claim one voxel."""


class SegmentationTypeMismatchError(VoxelError):
    """A mask was asked of a fractional segment, or a field of another one."""


class NotDoseError(VoxelError):
    """The dataset is not a dose."""


class MalformedDoseGridError(VoxelError):
    """A dose lacks a part or contradicts itself."""


class ConversionError(VoxelError):
    """A conversion can't be done."""


class MissingThresholdError(ConversionError):
    """A fractional segment needs a threshold."""


class SegmentNotFoundError(ConversionError):
    """There is no such segment."""
