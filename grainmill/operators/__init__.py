"""operators"""

from . import matching as matching  # its commands are known once the package is imported
