import sys

from pyspark import cloudpickle

# As in the package: functions for Python workers travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
